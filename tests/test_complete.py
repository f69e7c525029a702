"""Completeness of media: the stream gives the batch result, whatever the order, delays and repeats."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import complete as S

OUT, MEDIA = "media_id long, frame long, model string, ts timestamp", "media_id long, frames long, models array<string>, ts timestamp"
START = datetime(2024, 5, 1)


def at(s):
    return START + timedelta(seconds=s)


def cases():
    """Outputs and announcements of media: complete, with gaps at every place, not announced, announced without outputs, repeated."""
    r, out, media = random.Random(3), [], []
    for m in range(24):
        frames, models = r.randint(1, 6), r.sample(["a", "b", "c"], r.randint(1, 3))
        base = m * 20
        media.append((m, frames, models, at(base + r.randint(0, 9))))
        lost = {(r.randrange(frames), r.choice(models)) for _ in range(2)} if m % 3 == 0 else set()
        for f in range(frames):
            for model in ["a", "b", "c"]:  # also models that are not expected
                if (f, model) not in lost:
                    out += [(m, f, model, at(base + r.randint(0, 9)))] * r.randint(1, 2)
        out.append((m, frames + 3, "a", at(base)))
    media += [(100, 3, ["a"], at(5)), (101, 0, ["a"], at(6)), (102, 4, ["a", "a", "b"], at(7)), media[1]]
    out += [(103, 0, "a", at(8)), (102, 3, "a", at(8)), (102, 0, "a", at(8)), (102, 0, "b", at(9))]
    return out, media


def by_hand(out, media):
    told = {}
    for m, frames, models, _ in media:
        told.setdefault(m, (frames, set(models)))
    rows = set()
    for m in {r[0] for r in out} | set(told):
        if m not in told:
            rows.add((m, None, 0, None, None, False))
            continue
        frames, models = told[m]
        want = {(f, k) for f in range(frames) for k in models}
        got = want & {(f, k) for i, f, k, _ in out if i == m}
        rows.add((m, len(want), len(got), len(want - got), min((f for f, _ in want - got), default=None), want == got))
    return rows


def test_batch_equals_definition(spark):
    out, media = cases()
    got = S.complete_media(spark.createDataFrame(out + [(1, None, "a", at(1)), (1, 0, None, at(1))], OUT), spark.createDataFrame(media, MEDIA))
    assert {tuple(r) for r in got.collect()} == by_hand(out, media)
    assert S.complete_media(spark.createDataFrame([], OUT), spark.createDataFrame([], MEDIA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    out, media = cases()
    r = random.Random(seed)
    rows = [("o", x) for x in out] + [("m", x) for x in media]
    r.shuffle(rows)  # out of order and across batches, all within the delay
    third = len(rows) // 3
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    try:
        end = [("o", (999, 0, "a", at(100_000)))]  # moves the watermark past every timeout
        again = r.sample(rows, 20)  # repeats long after they were emitted are late
        for k, part in enumerate((rows[:third], rows[third : 2 * third] + r.sample(rows[:third], 5), rows[2 * third :], end, again, end)):
            spark.createDataFrame([x for kind, x in part if kind == "o"], OUT).coalesce(1).write.parquet(f"{tmp_path}/out/b{k}")
            spark.createDataFrame([x for kind, x in part if kind == "m"], MEDIA).coalesce(1).write.parquet(f"{tmp_path}/media/b{k}")
            read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}/*")
            found = S.stream_complete_media(read("out", OUT), read("media", MEDIA), "1000 seconds", 600)
            query = found.writeStream.format("parquet").option("path", f"{tmp_path}/result").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/result").where("media_id < 999").select(*[c.split()[0] for c in S.RESULT.split(", ")]).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(out, media)
    batch = S.complete_media(spark.createDataFrame(out, OUT), spark.createDataFrame(media, MEDIA))
    assert set(got) == {tuple(x) for x in batch.collect()}
    assert batch.where(F.col("complete")).count() > 5
