from hypothesis import given, settings, strategies as st

from strophe.operators.packed import LIST_SEPARATORS, TEXT_SEPARATORS, split_packed, tokenize_cell

PLAIN = st.text(alphabet="abc xyz木叶:-_", min_size=1, max_size=12).map(str.strip).filter(bool)
ANY = st.text(alphabet='ab;,|/、；\t" \\木x', min_size=1, max_size=12).map(str.strip).filter(bool)


def test_known_cells():
    t = tokenize_cell
    assert t("a;b;;c;", LIST_SEPARATORS) == ["a", "b", "c"]
    assert t('["flute, small; bone", "\\"long\\" horn", "a"]', LIST_SEPARATORS) == ["flute, small; bone", '"long" horn', "a"]
    assert t('x；"y ""q"" z"，w', LIST_SEPARATORS) == ["x", 'y "q" z', "w"]
    assert t("“rivers | lakes”; 「lute/zither」", LIST_SEPARATORS) == ["rivers | lakes", "lute/zither"]
    assert t("flute\\, small\\; bone;b", LIST_SEPARATORS) == ["flute, small; bone", "b"]
    assert t("uploader: x, y troupe|album a/b", TEXT_SEPARATORS) == ["uploader: x, y troupe", "album a/b"]
    assert t('["a, b", "c; see d"]', TEXT_SEPARATORS) == ["a, b", "c; see d"]
    assert t("(a; b) c", TEXT_SEPARATORS) == ["(a; b) c"]
    assert t('a "quoted" word; b', TEXT_SEPARATORS) == ['a "quoted" word', "b"]
    assert t('"open; b', TEXT_SEPARATORS) == ['"open', "b"]
    assert t("", LIST_SEPARATORS) == [] and t(" ; ;", LIST_SEPARATORS) == [] and t("[]", LIST_SEPARATORS) == []


def test_depth():
    t = tokenize_cell
    assert t("a (b; c); d", TEXT_SEPARATORS) == ["a (b; c)", "d"]
    assert t("[[a; b]; c]", TEXT_SEPARATORS) == ["[a; b]", "c"]
    assert t("[a; {b; (c; d)}]; e", TEXT_SEPARATORS) == ["[a; {b; (c; d)}]", "e"]
    assert t("a (b; c", TEXT_SEPARATORS) == ["a (b", "c"] and t("a) b; c", TEXT_SEPARATORS) == ["a) b", "c"]
    assert t("(a [b); c]; d", TEXT_SEPARATORS) == ["(a [b)", "c]", "d"]
    assert t('x ("p)"; q); r', TEXT_SEPARATORS) == ['x ("p)"; q)', "r"]
    assert t("a (b\\; c\\); d", TEXT_SEPARATORS) == ["a (b; c)", "d"]
    assert t('["a]; b", "c"]', TEXT_SEPARATORS) == ["a]; b", "c"]
    assert t("（甲；乙）；丙", LIST_SEPARATORS) == ["（甲；乙）", "丙"]
    deep = "(" * 50_000
    assert t(deep + "a;b" + ")" * 50_000, TEXT_SEPARATORS) == [deep[1:] + "a;b" + ")" * 49_999]
    assert t(deep + "a;b", TEXT_SEPARATORS) == [deep + "a", "b"]
    assert len(t(";".join(["“x"] * 50_000), TEXT_SEPARATORS)) == 50_000


@settings(max_examples=200, deadline=None)
@given(st.lists(PLAIN, min_size=1, max_size=6), st.sampled_from([";", "；", ", ", "|", " / ", "\n", "、"]))
def test_plain_round_trip(values, sep):
    values = [v for v in values if not any(c in v for c in LIST_SEPARATORS)]
    assert tokenize_cell(sep.join(values), LIST_SEPARATORS) == values


@settings(max_examples=200, deadline=None)
@given(st.lists(ANY, min_size=1, max_size=6))
def test_quoted_round_trip(values):
    cell = ";".join('"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' for v in values)
    assert tokenize_cell(cell, LIST_SEPARATORS) == values


def test_rows(spark):
    long = ";".join(f"v{i}" for i in range(20_000))
    rows = [("a", "x;y;x", "k"), ("a", "x;y;x", "k"), ("b", None, "k"), ("c", "", "k"), ("d", "NA", "k"), ("e", "one", "k"), (None, "p;q", "k"), ("f", long, "k"), ("g", " ; ", "k")]
    df = spark.createDataFrame(rows, "id string, flags string, pos string")  # a column that clashes with the result's
    out = [tuple(r) for r in split_packed(df, "id", {"flags": LIST_SEPARATORS}, least=2).collect()]
    assert sorted(r for r in out if r[0] == "a") == [("a", "flags", 0, "x"), ("a", "flags", 1, "y"), ("a", "flags", 2, "x")]
    assert sorted(r[3] for r in out if r[0] is None) == ["p", "q"]
    assert sum(r[0] == "f" for r in out) == 20_000
    assert {r[0] for r in out} == {"a", "f", None}
    assert split_packed(df.where("false"), "id", {"flags": LIST_SEPARATORS}).count() == 0
    assert ("e", "flags", 0, "one") in [tuple(r) for r in split_packed(df, "id", {"flags": LIST_SEPARATORS}).collect()]


def test_bracketed_commas_pass_the_filter(spark):
    """A written list of quoted values is parted at commas in any field, also where the cell holds no separator of its field."""
    cells = ['["title only", "uploader: x, county folk troupe"]', '\u3000 ["a", "b"]', '【“a”,“b”】', '["one, only"]', "[a, b]", "a, b", '("x"; "y")']
    df = spark.createDataFrame(list(enumerate(cells)), "id int, cell string")
    got = {}
    for r in sorted(split_packed(df, "id", {"cell": TEXT_SEPARATORS}, least=2).collect(), key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append(r.piece)
    assert got == {i: v for i, c in enumerate(cells) if len(v := tokenize_cell(c, TEXT_SEPARATORS)) > 1}
    assert got[0] == ["title only", "uploader: x, county folk troupe"] and set(got) == {0, 1, 2, 6}
