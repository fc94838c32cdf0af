import random
import time

import pytest
from pyspark.sql import functions as F

from meritgraph.operators import markdown
from meritgraph.operators.markdown import spans

CASES = [
    (None, []), ("", []), ("  \n\t\n", []),
    ("one\ntwo", ["one two"]), ("one  \ntwo\\\nthree", ["one", "two", "three"]), ("a\n\nb", ["a", "b"]), ("a\r\nb", ["a b"]),
    ("*a* **b** ***c*** _d_ __e__", ["a b c d e"]), ("**a*b**", ["a*b"]), ("*a**b*", ["a**b"]), ("a_b_c * d", ["a_b_c * d"]), ("*(**x**)*", ["(x)"]), ("**a *b** c*", ["a b c"]), ("*a __b *c d__ e*", ["a b *c d e"]), (r"\*a\* \x", [r"*a* \x"]),
    ("text `#1` more", ["text ", " more"]), ("````#1``` b", ["````#1``` b"]), ("``a ` b`` c", [" c"]),
    ("a\n```\n#1\n```\nb", ["a", "b"]), ("~~~ x\n#1\n```\n~~~~\nb", ["b"]), ("```\nnever closed", []), ("``` a`b\nc", ["``` a`b c"]),
    ("a\n\n    #1\n\nb", ["a", "b"]), ("a\n    b", ["a b"]), ("\t#1\nb", ["b"]),
    ("# a #\nb", ["a", "b"]), ("#1 is no heading", ["#1 is no heading"]), ("a\n===\nb\n---\nc", ["a", "b", "c"]), ("a\n***\nb", ["a", "b"]),
    ("> a\nb\n\nc", ["a b", "c"]), ("> ```\n> #1\nb", ["b"]), ("- a\n- b\n\n  c\n      d", ["a", "b", "c d"]), ("1. a\n2. b", ["a", "b"]), ("a\n2. b", ["a 2. b"]), ("-     code\n- x", ["x"]), ("- a\n\n      code\n\nb", ["a", "b"]), ("* a\n\tb", ["a b"]), ("-\ta", ["a"]), ("> - a\n> - b", ["a", "b"]),
    ("[a](b) [c](<d e> \"t\") ![i](j) [k]", ["a c i [k]"]), ("[a [b](c) d](e)", ["[a b d](e)"]), ("[![x](y)](z)", ["x"]), ("![ [x [a](b) ] ](c)", [" [x a ] "]), ("[*a](b)*", ["*a*"]), ("[l]: /u \"t\"\n\n[a][l] [l] [l][] [m]", ["a l l [m]"]),
    ("<http://x.y/#1> <a@b.c>", ["http://x.y/#1 a@b.c"]), ("see <em>#1, #2</em>", ["see #1, #2"]), ("see <code>#1 <b>x</b> `y` #2</code> end", ["see  end"]), ("<div>\n#1\n\n#2", ["#2"]), ("<!-- #1\n\n#2 -->\n#3", ["#3"]), ("a <!-- b --> c", ["a  c"]), ("<b>\n#1", []), ("a\n<b>\n#1", ["a  #1"]), ("<pre>\n#1\n\n#2</pre>\n#3", ["#3"]), ("1 < 2 & 3 &amp; &#35;4 &nosuch;", ["1 < 2 & 3 & #4 &nosuch;"]),
    ("see <code>\n\n#1\n\n</code> #2", ["see ", " #2"]),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_spans(text, expected):
    assert spans(text) == expected


def wrapped(r, depth=0):
    """(Markdown of one line, its text) at random."""
    pick = r.randrange(7 if depth < 3 else 2)
    if pick < 2:
        word = "".join(r.choice("abcdé#12") for _ in range(r.randint(1, 5)))
        return word, word
    inner = [wrapped(r, depth + 1) for _ in range(r.randint(1, 3))]
    md, text = " ".join(a for a, _ in inner), " ".join(b for _, b in inner)
    if pick == 2:
        return f"**{md}**" if depth == 0 else md, text
    if pick == 3:
        return f"![{md}](/u(v) 't')", text
    if pick == 4:
        return f"<b class='x'>{md}</b>", text
    return (f"[{md}](<u v>)", text) if depth == 0 and "](" not in md else (md, text)


def block(r, depth=0):
    """(lines, spans) of a block at random."""
    pick = r.randrange(9 if depth < 3 else 6)
    md, text = wrapped(r)
    if pick <= 1:
        more, t = wrapped(r)
        return ["x " + md, "y " + more], [f"x {text} y {t}"]
    if pick == 2:
        return [f"## {md} x"], [f"{text} x"]
    if pick == 3:
        return ["~~~", md, "", "    #9", "~~~"], []
    if pick == 4:
        return ["<div>", md, "</div>"], []
    if pick == 5:
        return [f"x {md} `` {r.choice(['#7', '`', '**'])} `` end"], [f"x {text} ", " end"]
    inner, found = [], []
    for _ in range(r.randint(1, 3)):
        lines, s = block(r, depth + 1)
        inner += [*lines, ""]
        found += s
    if pick == 6:
        return ["> " + x for x in inner], found
    marker = r.choice(["- ", "* ", "12. "])
    return [(marker if i == 0 else " " * len(marker)) + x for i, x in enumerate(inner)], found


def test_spans_of_invented_documents():
    r = random.Random(5)
    for _ in range(3_000):
        lines, expected = [], []
        for _ in range(r.randint(1, 4)):
            own, s = block(r)
            lines += [*own, "", "<!-- x -->", ""]
            expected += s
        assert spans("\n".join(lines)) == expected, "\n".join(lines)


def test_long_texts_take_time_in_proportion():
    for unit in ("`a ", "``a` ", "*a **b ", "[a", "![", "](b)", "<!-- ", "<a b=", "_a* ", "&a", "> ", "- a\n", "x\n\n", "a*b_c"):
        began = time.time()
        spans(unit * (200_000 // len(unit)))
        assert time.time() - began < 5, unit
    r = random.Random(1)
    for _ in range(2_000):
        spans("".join(r.choice("ab *_`[]()<>!&\\\n#-=1. \t\"'") for _ in range(60)))


def found(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")
    return {(r.id, r.ref): (r.ref_type, r.n) for r in markdown.references(rows, "id", "body").collect()}


def test_references(spark):
    sha = "AB" * 20
    got = found(spark, "#1, #2, and #3. foo#123 #124bar `#5`", "see own-er/re.po_#7 @ann, paired with @bob: @bob", f"{sha} https://github.com/o/r/commit/{sha}", "https://github.com/o/r/pull/3#issuecomment-12 http://github.com/o, https://github.com/o/r/issues/x", None)
    b = "BASIC"
    expected = {(0, "#1"): (b, 1), (0, "#2"): (b, 1), (0, "#3"): (b, 1), (1, "own-er/re.po_#7"): (b, 1), (1, "@ann"): (b, 1), (2, sha.lower()): (b, 1), (2, f"https://github.com/o/r/commit/{sha.lower()}"): (b, 1), (3, "https://github.com/o/r/pull/3#issuecomment-12"): (b, 1), (3, "http://github.com/o"): (b, 1)}
    bob = {k: got.pop(k) for k in list(got) if k[1] == "@bob"}
    assert got == expected
    rows = spark.createDataFrame([(1, "Paired-with @bob and @bob")], "id int, body string")
    assert sorted(map(tuple, markdown.references(rows, "id", "body").collect())) == [(1, "@bob", "BASIC", 1), (1, "@bob", "PAIRED_WITH", 1)] and bob


def test_dictionaries(spark):
    t = lambda *rows: spark.createDataFrame(rows, "ref string, address string")
    got = markdown.dictionary([t(("#1", "z/"), ("@a", "u/a/")), t(("#1", "b/"))])
    assert sorted(map(tuple, got.collect())) == [("#1", "b/"), ("@a", "u/a/")]
    assert markdown.detector([t(("x", "a/")), t(("x", "a/"), ("y", "b/"))]).count() == 2
    with pytest.raises(Exception, match="two addresses for x"):
        markdown.detector([t(("x", "a/")), t(("x", "b/"))]).collect()


def test_ids_in_links(spark):
    u = "https://github.com/o/r/"
    rows = spark.createDataFrame([(u + x,) for x in ("pull/1#pullrequestreview-22", "issues/1#issuecomment-3", "pull/1#issuecomment-4", "pull/1#discussion_r5", "pull/1")], "url string")
    assert [r.x and tuple(r.x) for r in rows.select(markdown.url_id(F.col("url")).alias("x")).collect()] == [("review", "22"), ("issue_comment", "3"), ("pull_comment", "4"), ("review_comment", "5"), None]


def test_texts_are_scanned_in_slices_of_arrow_batches(spark):
    texts = [None if i % 7 == 0 else f"a *b{i}*\n\n`c`" for i in range(2 * markdown.SLICE + 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    found = markdown.with_spans(rows, "text")
    assert "MapInArrow" in found._jdf.queryExecution().toString()  # a pandas function holds a whole batch's spans
    assert {r.id: (r.text, r.spans) for r in found.collect()} == {i: (t, markdown.spans(t)) for i, t in enumerate(texts)}
