import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from stylograph.operators import multivalue as M

VALUES = ["red", "green, dark", "blue", "black / white", "grey", 'so "called"']


def cells():
    one = [v for v in VALUES for _ in range(3)] + [f'c("{v}")' for v in VALUES if '"' not in v]
    two = [f"{a}{d}{b}" for a, b in itertools.permutations(VALUES, 2) for d in (", ", " / ", "; ", " | ", "\n")]
    return one + two


def split(spark, values, key=None):
    df = spark.createDataFrame([(key or f"k{i}", v, i) for i, v in enumerate(values)], "doc_id string, f string, pos int")
    out = {}
    for r in M.split_values(df, ["f"]).orderBy("doc_id", "pos").collect():
        out.setdefault(r.doc_id, []).append(r.val)
    return out


def test_learns_values_with_delimiters_inside(spark):
    made = split(spark, cells())
    for i, c in enumerate(cells()):
        want = [v for v in VALUES if v in c]
        assert sorted(made[f"k{i}"]) == sorted(want), c


def test_forms(spark):
    q = r'c("so \"called\"", "a; b", NA)'
    made = split(spark, [q, '"a; b","x"', "['u', 'v']", "x; y;", "x||y", "  x  ", "", None, "NA", "NA; x", "x;\n;y", '"say ""x"""; y'])
    assert made == {"k0": ['so "called"', "a; b"], "k1": ["a; b", "x"], "k2": ["u", "v"], "k3": ["x", "y"], "k4": ["x", "y"], "k5": ["x"], "k9": ["x"], "k10": ["x", "y"], "k11": ['say "x"', "y"]}


def test_repeated_rows_and_empty_table(spark):
    assert split(spark, ["x; y", "x; y"], key="k") == {"k": ["x", "y"]}
    assert M.split_values(spark.createDataFrame([], "doc_id string, f string"), ["f"]).count() == 0


def test_long_cell(spark):
    made = split(spark, ["; ".join(f"v{i}" for i in range(500))])
    assert made["k0"] == [f"v{i}" for i in range(500)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab,;\"' |\\", max_size=14))
def test_lattice_is_a_path_graph(cell):
    nodes, edges = M.lattice(cell)
    reach = {0}
    for a, b, *_ in sorted(edges):
        assert 0 <= a < b < nodes
        if a in reach:
            reach.add(b)
    assert nodes - 1 in reach
    weights = [0.0] * len(edges)
    assert all(-1e-9 <= e <= 1 + 1e-9 for e in M.expected(nodes, edges, weights))
    M.viterbi(nodes, edges, weights)


def test_values_of_many_delimiters(spark):
    long = "a, b, c, d, e, f, g"
    values = [f'c("{long}")', f'c("{long}", "x")', f"{long}; x", f"{long}; y", "x", "y", "x; y", "y / x"]
    for inner in (32, None):
        df = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)], "doc_id string, f string")
        made = {}
        for r in M.split_values(df, ["f"], model=M.Model(inner=inner)).orderBy("doc_id", "pos").collect():
            made.setdefault(r.doc_id, []).append(r.val)
        assert made["k0"] == [long] and made["k1"] == [long, "x"] and made["k2"] == [long, "x"] and made["k3"] == [long, "y"], made


def test_a_cell_of_most_rows_and_empty_elements(spark):
    rows = [(f"k{i}", "x; y;;;NA") for i in range(300)] + [("z", ";;;"), ("y", ";x;")]
    df = spark.createDataFrame(rows, "doc_id string, f string")
    made = sorted((r.doc_id, r.pos, r.val, r.n) for r in M.split_values(df, ["f"]).collect())
    assert made == sorted([(f"k{i}", p, v, 2) for i in range(300) for p, v in ((1, "x"), (2, "y"))] + [("y", 1, "x", 1)])
    empty = M.segment_cells(spark.createDataFrame([("f", ";;;")], "field string, cell string")).collect()
    assert [tuple(r) for r in empty] == [("f", ";;;", [])]
