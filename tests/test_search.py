import pytest
from pyspark.sql import functions as F

from logsluice.operators import search as s

MESSAGES = [
    "harbour crane delayed: rope worn through",
    "harbour crane delayed: rope",
    "harbour crane delayed:",
    "harbour alone",
    "crane delayed: rope without the first word",
    "nothing of all that",
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(str(i), "info", m, None, None, None, None) for i, m in enumerate(MESSAGES)]
    data.append(("8", "error", "50% off C:\\App\\Jobs", '{"k":"payment"}', "/app/x.php", 7, "Ünï"))
    schema = "id string, level string, message string, context string, source string, user_id bigint, channel string"
    df = spark.createDataFrame(data, schema)
    nothing = {c: F.lit(None).cast("string") for c in ("ip_address", "url", "trace_id", "http_method")}
    return df.withColumns(nothing).cache()


@pytest.mark.parametrize(
    "text, terms",
    [
        ("error", [("any", "error", False)]),
        ("message:error", [("message", "error", False)]),
        ("-message:debug", [("message", "debug", True)]),
        ('message:"parcel handed over"', [("message", "parcel handed over", False)]),
        ('-message:"a b"', [("message", "a b", True)]),
        ("message:error level:warning", [("message", "error", False), ("level", "warning", False)]),
        ("message:error whatever", [("message", "error", False), ("any", "whatever", False)]),
        ("nosuchfield:thing", [("any", "nosuchfield:thing", False)]),
        ("-nosuch:thing", [("any", "-nosuch:thing", False)]),
        ("MESSAGE:x", [("message", "x", False)]),
        ("-debug", [("any", "debug", True)]),
        ("-", [("any", "-", False)]),
        ('-"a b"', [("any", '"a', True), ("any", 'b"', False)]),
        ("delayed: x", [("any", "delayed:", False), ("any", "x", False)]),
        ("user_id:0", [("user_id", "0", False)]),
        ("  ", []),
    ],
)
def test_terms(text, terms):
    assert [tuple(t) for t in s.terms_of(text)] == terms


@pytest.mark.parametrize(
    "value, structured",
    [
        ("harbour crane delayed: rope", False),
        ("delayed:", False),
        ("foo:bar", False),
        ("a-b", False),
        ("foo -bar", True),
        ('"a b"', True),
        ("level:error", True),
        ("xlevel:error", False),
        ("level: error", False),
    ],
)
def test_is_structured(value, structured):
    assert s.is_structured(value) is structured


@pytest.mark.parametrize(
    "value",
    [
        "harbour crane delayed: rope",
        "harbour crane",
        "level:error message:payment",
        '"harbour crane delayed: rope"',
        "foo -bar",
        "source:x",
        "user_id:7",
        "channel:ünï",
    ],
)
@pytest.mark.parametrize("regex", [False, True])
def test_excluding_is_the_exact_complement(rows, value, regex):
    include = s.search([{"value": value}], regex)
    exclude = s.search([{"value": value, "exclude": True}], regex)
    row = rows.agg(
        F.count_if(include).alias("i"), F.count_if(exclude).alias("e"), F.count(F.lit(1)).alias("n")
    ).first()
    assert row.i + row.e == row.n == 7
    assert s.complement_check(rows, include).first().ok


def ids(rows, condition):
    return [r.id for r in rows.where(condition).orderBy("id").collect()]


def test_matches(rows):
    assert ids(rows, s.search([{"value": "harbour crane delayed: rope"}])) == ["0", "1"]
    assert ids(rows, s.search([{"value": "harbour delayed:"}])) == []
    two = [{"value": "harbour"}, {"value": "rope", "exclude": True}]
    assert ids(rows, s.search(two)) == ["2", "3"]
    assert ids(rows, s.search([{"value": "PAYMENT"}])) == ["8"]
    assert ids(rows, s.search([{"value": "user_id:7"}])) == ["8"]
    assert ids(rows, s.search([{"value": "", "exclude": True}])) == [str(i) for i in range(6)] + ["8"]
    assert ids(rows, s.search([{"value": "level:error", "exclude": "0"}])) == ["8"]
    assert ids(rows, s.search([{"value": "level:error"}], search_syntax=False)) == []


def test_wildcards_and_backslashes(rows):
    assert ids(rows, s.contains_term("message", "App\\Jobs")) == ["8"]
    assert ids(rows, s.contains_term("message", "50% off")) == ["8"]
    assert ids(rows, s.contains_term("message", "5_%", wildcards=True)) == ["8"]
    assert ids(rows, s.contains_term("message", "5_%", wildcards=False)) == []
    assert ids(rows, s.contains_term("message", "APP\\", wildcards=False)) == ["8"]
    assert ids(rows, s.contains_term("message", "APP", case_sensitive=True)) == []


def test_regex(rows):
    assert ids(rows, s.regex_term("any", "^HARBOUR (crane|alone)$")) == ["3"]
    assert ids(rows, s.search_text("-message:^harbour source:x", regex=True)) == ["8"]
