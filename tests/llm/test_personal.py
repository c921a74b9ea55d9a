import pytest

from skein.llm import personal

PEOPLE = [("Brynja Ullverton",), ("Kaspar Halloweck",), ("Elodie Ibáñoz",), (None,)]


def kinds(spark, *texts):
    df = spark.createDataFrame([("turn", i, t, "x", "y") for i, t in enumerate(texts)], "src string, row_id bigint, text string, kind string, start string")
    spans = personal.found_spans(df, spark.createDataFrame(PEOPLE, "display_name string"))
    got = {i: set() for i in range(len(texts))}
    for r in spans.collect():
        got[r.row_id].add(r.kind)
    return got, {r.row_id: r.text for r in personal.redacted(df, spans).collect()}


POSITIVE = {
    "email": ["Reach me at a.b+c@mail.example.", "x [at] mail (dot) example", "joe AT mail DOT example", "q＠corp-post.test", "r @ team.example.org!"],
    "phone": ["call +1 (617) 555-0138", "tel. 01.99.00.22.62", "电话 415-555-0141我们", "my number is 0034 600 000 480", "móvil 030/23125-683", "phone=+86 199-0000-0582", "tél. ４１５-５５５-０１８５"],
    "id_number": ["SSN on file 975 06 0844", "mi DNI es 74349953-S", "national insurance QQ 16 39 17 C", "passport no. Q00213032", "身份证号 990101198503028425", "numéro de sécu 2 45 11 99 492 852 61", "Steuer-ID 81 987 265 794"],
    "address": ["at 1811 Bellweather Ave Apt 31, Mossgate!", "P.O. Box 9366", "Am Krähenholz 44, 00753 Altenwieck", "36, avenue du Moulin Gris, 99710 Valmorane", "C/ Los Nogales 142, 99442 Torrelonda", "云泽市青禾路150号2621室"],
    "name": ["联系人是褚砚秋", "Mme van Hoolte wants it", "Dr. B. Pellegrast signed", "ask Kaspar Halloweck", "hi, this is brynja ullverton from support", "assignee: Ibáñoz, Elodie"],
}


def test_kinds(spark):
    texts = [t for group in POSITIVE.values() for t in group]
    want = [k for k, group in POSITIVE.items() for _ in group]
    got, _ = kinds(spark, *texts)
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != {want[i]}] == []


NEGATIVE = [
    "Pin rollup@5.84.2 and util-kit@^2.5.0", "user@tenant", 'Use @app.get("/v9/quota")', "Batch 155-49-67 of the replay", "Range 18-24-3156 in the fixture", "SKU 00-4463-29-X is a fixture",
    "Trace 7c9e7179-7435-40de-944b-e07fc1f90ae7", "192.0.2.13:8427", "since 2024-05-16", "Row 141783944 has checksum 28557781", "The Silent Otter release ships with Apache Arrow", "Look (at) the dot product",
    "the Avenue pattern puts all routes in one file", "1762176437000", "", None, "git@host.example:repo/x", "Semver 12.421.0364 broke", "9" * 40,
]


def test_no_cases(spark):
    got, texts = kinds(spark, *NEGATIVE)
    assert {NEGATIVE[i]: k for i, k in got.items() if k} == {}
    assert [texts[i] for i in range(len(NEGATIVE))] == NEGATIVE


def test_rest_stays(spark):
    _, texts = kinds(spark, "ａ mail x@y.example, call +12125550140;  ok 　\n")
    assert texts[0] == "ａ mail [EMAIL], call [PHONE];  ok 　\n"


def test_graph_finds_unseen_names(spark):
    seeds = ["escalate to Brynja Ullverton today", "escalate to Kaspar Halloweck today", "escalate to Elodie Ibáñoz today", "escalate to Zorvath Quillmere today", "then Zorvath Quillmere left", "Load Balancer today"]
    got, _ = kinds(spark, *seeds)
    assert all(got[i] == {"name"} for i in range(5)) and got[5] == set()


def test_graph_finds_numbers_by_shape_and_addresses_by_context(spark):
    texts = ["call 212-555-0101", "phone 212-555-0102", "tel 212-555-0103", "we saw 212-555-0104 twice"]
    texts += ["batch 77-4411-9", "batch 78-4412-9", "batch 79-4413-9", "we saw 80-4414-9 twice"]
    texts += [f"please deliver to {i} Old Quarry Road, Mossgate" for i in (11, 12, 13)] + ["please deliver to 14 Baker Street", "the plan is 15 Fleet Street"]
    got, _ = kinds(spark, *texts)
    assert all(got[i] == {"phone"} for i in range(4)) and not any(got[i] for i in range(4, 8))
    assert all(got[i] == {"address"} for i in range(8, 12)) and got[12] == set()


def test_a_frequent_phrase_beside_names_is_no_name(spark):
    """One phrase that often stands where names stand once stays a phrase, however many records it has."""
    people = ["Brynja Ullverton", "Kaspar Halloweck", "Elodie Ibáñoz"]
    texts = [f"we talked to {p} about it" for p in people] + ["Als Nächstes wird die Sache geprüft"] * 30 + ["we talked to Als Nächstes about it"]
    got, _ = kinds(spark, *texts)
    assert all(got[i] == {"name"} for i in range(3)) and not any(got[i] for i in range(3, 34))


def test_empty(spark):
    df = spark.createDataFrame([], "src string, row_id bigint, text string")
    assert personal.found_spans(df, spark.createDataFrame(PEOPLE, "display_name string")).count() == 0


@pytest.mark.parametrize("n", [200_000])
def test_long(n):
    personal.mentions("word " * n)
    personal.mentions("1" * n)
    personal.mentions("A" * n)
