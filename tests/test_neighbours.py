import random

from pyspark.sql import functions as F

from skein.operators.neighbours import with_previous, with_running


def test_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(200), i, rng.choice([None, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o bigint, id bigint, v bigint")
    bucket = F.floor(F.col("o") / 7)
    got = {r.id: (r.prev_v, r.prev_id, r.total) for r in with_running(with_previous(df, "k", bucket, ["o", "id"], ["v", "id"]), "k", bucket, ["o", "id"], F.col("v"), "total").collect()}
    assert len(got) == 400
    for key in ("a", "b", None):
        before, total = (None, None), 0
        for _, o, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            assert got[i] == (*before, total)
            before, total = (v, i), total + (v or 0)
