import pytest
from pyspark.sql import functions as F

from authorlens.functions import structure
from authorlens.operators import features, tree
from tests.snippets import JAVA, PYTHON, ROLES, TYPESCRIPT


@pytest.fixture(scope="module")
def blocks(spark):
    df = spark.createDataFrame([(k, c, k) for k, (c, _) in ROLES.items()] + [("typescript", TYPESCRIPT, "typescript")],
                               "id string, code string, detected_language string")
    out = {}
    for r in features.code_blocks(df).collect():
        out.setdefault(r.id, []).append(r)
    return out


@pytest.mark.parametrize("lang", list(ROLES))
def test_role_counts(blocks, lang):
    got = [b.role for b in blocks[lang]]
    for role, n in ROLES[lang][1].items():
        name = role.rstrip("_")
        assert got.count("for" if (lang, name) == ("go", "while") else name) == n, name


def test_python_spans_and_depth(blocks):
    found = {(b.role, b.start): (b.finish, b.depth) for b in blocks["python"]}
    assert found[("function", 4)] == (20, 1)
    assert found[("if", 7)] == (13, 2)      # up to the last line of its else part
    assert found[("for", 8)] == (9, 3)
    assert found[("class", 3)] == (23, 1)
    assert [b.name for b in blocks["python"] if b.role == "function"] == ["add", "names"]


def test_java_spans(blocks):
    f = [b for b in blocks["java"] if b.role == "function"][0]
    assert (f.name, f.start, f.finish) == ("addAll", 5, 16)


def test_features(spark):
    df = spark.createDataFrame([("p", PYTHON, "python"), ("j", JAVA, "java")], "id string, code string, language string")
    got = {r.id: r for r in features.extract_features(df).collect()}
    p = got["p"]
    filled = sum(1 for l in PYTHON.splitlines() if l.strip())
    assert p.function_density == pytest.approx(2 / filled)
    assert p.avg_args_per_function == 2.0       # self, item, extra and self
    assert p.max_nesting_depth == 3
    assert p.cyclomatic_complexity_approx == pytest.approx((1 + 1 + 1 + 1 + 1) / 2)
    assert got["j"].avg_args_per_function == 2.0
    assert got["j"].num_docstrings == 1 and got["j"].max_function_length == 12


def test_windows_agree_with_fold(spark):
    """Nesting of the window operators over code events equals the row-local fold."""
    df = spark.createDataFrame([(k, c, k) for k, (c, _) in ROLES.items()], "id string, code string, detected_language string")
    events = tree.events_from_code(df)
    got = {r.id: r.max_nesting_depth for r in tree.nesting(events).collect()}
    want = {r.id: r.max_nesting_depth for r in features.structure_features(df).collect()}
    assert got == want
    for r in tree.spans(events).filter("role = 'function' and id = 'python'").collect():
        assert r.finish >= r.start


def test_long_lines_do_not_overflow(spark):
    code = 'x = "' + "a\\n" * 50_000 + '"\n' + "f(" * 200 + ")" * 200
    df = spark.createDataFrame([("a", code, "python"), ("b", code, "java")], "id string, code string, language string")
    assert features.extract_features(df).filter("ast_depth > 100").count() == 2


@pytest.mark.parametrize("code, names, functions", [
    ("— “a” … b", ["a", "b"], []),                      # signs beyond ASCII are no names
    ("x = f'half open\ny = rb\"z", ["x", "y"], []),     # nor is a prefixed string that never closes
    ("def\tone(a):\nasync\tdef two():", ["one", "a", "two"], ["one", "two"]),
    ("def\ndef (a)\n", ["a"], []),                      # a head without a name names nothing
    ("a # it's 'x'", ["a"], []),
])
def test_names_of_odd_texts(spark, code, names, functions):
    df = features.with_shape(spark.createDataFrame([("1", code, "python")], "id string, code string, detected_language string"))
    r = df.select("_names", structure.function_names(F.col("_blocks")).alias("f"), "_kinds").first()
    assert (r._names, r.f) == (names, functions)
    assert "#" not in code or r._kinds[-1] == "comment"
