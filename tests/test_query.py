import pytest

from quarrylog.plans.query import And, Exists, Field, Key, Level, Not, Or, QueryError, parse, parse_option


def num(name, op, value, **more):
    return Field(Key(name), op, value, True, **more)


@pytest.mark.parametrize(
    "text, tree",
    [
        (".a=1 or .b=2 and .c=3", Or((num("a", "=", "1"), And((num("b", "=", "2"), num("c", "=", "3")))))),
        (".a=1 && .b=2 || .c=3", Or((And((num("a", "=", "1"), num("b", "=", "2"))), num("c", "=", "3")))),
        ("not .a=1 and .b=2", And((Not(num("a", "=", "1")), num("b", "=", "2")))),
        ("!(.a=1 or .b=2)", Not(Or((num("a", "=", "1"), num("b", "=", "2"))))),
        ("level >= WARN", Level(">=", 1)),
        ("Level ne e", Level("!=", 0)),
        ("exists(.a.[].b)", Exists(Key("a.[].b"))),
        ("msg contains x", Field(Key("message", True), "contains", "x")),
        ('"msg" = x', Field(Key("msg"), "exact", "x")),
        ("a not in (1, 2.5)", Field(Key("a"), "in", ("1", "2.5"), True, True)),
        ('a in (1, b, "c d")', Field(Key("a"), "in", ("1", "b", "c d"))),
        ("price?!=3", num("price", "!=", "3", absent=True)),
        ("a = 95c72", Field(Key("a"), "exact", "95c72")),
        ("a not matches ^x", None),
        ('a !~~= "^x"', Field(Key("a"), "regex", "^x", negated=True)),
    ],
)
def test_parse(text, tree):
    if tree is None:
        with pytest.raises(QueryError):
            parse(text)
    else:
        assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "a", "a=", "(a=1", "level > nope", "a in ()", "a < b", "a=1 b=2"])
def test_refused(text):
    with pytest.raises(ValueError):
        parse(text)


def test_option():
    assert parse_option("k=v") == Field(Key("k"), "exact", "v")
    assert parse_option("k?!~=v") == Field(Key("k"), "contains", "v", negated=True, absent=True)
    assert parse_option("msg~~=v") == Field(Key("message", True), "regex", "v")
    assert parse_option("a:b") == Field(Key("a"), "exact", "b")
    with pytest.raises(ValueError):
        parse_option("nothing")


def test_set_file(tmp_path):
    path = tmp_path / "set"
    path.write_text('line1\n"\\"line2\\""\nline3\n')
    assert parse(f"a in @{path}").value == ("line1", '"line2"', "line3")
    path.write_text('ok\n"open\n')
    with pytest.raises(ValueError, match="line 2"):
        parse(f"a in @{path}")
