from __future__ import annotations

import gzip
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from unitloom.operators import runlog as rl
from unitloom.sources import incremental, logs, text, zstd_lines
from unitloom.streaming import jobs


def test_jsonl_fields_and_precedence(spark, tmp_path):
    lines = ['{"text": "a", "content": "b"}', "", '{"text": "", "content": "c"}', '{"other": 1}', "not json", '{"content": "d"}']
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    path = str(tmp_path / "x.jsonl.gz")
    assert sorted(r.text for r in text.read_jsonl_text(spark, path).collect()) == ["a", "c", "d"]
    assert sorted(r.text for r in text.read_jsonl_text(spark, path, ("content", "text")).collect()) == ["b", "c", "d"]


def zstd_file(path, frames, skippable_at=None):
    packer = zstandard.ZstdCompressor(write_checksum=True)
    with open(path, "wb") as f:
        for i, frame in enumerate(frames):
            if i == skippable_at:
                f.write((0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"(\xb5/\xfd\n")
            f.write(packer.compress(frame))


@pytest.mark.parametrize("split", [1, 7, 40, 300, 1 << 20])
def test_zstd_lines_come_once_whatever_the_ranges(tmp_path, split):
    rng = random.Random(split)
    body = b"\n".join(bytes(rng.choices(b"abc\n {}", k=rng.randrange(120))) for _ in range(60)) + b"\n(\xb5/\xfd no frame\nlast"
    cuts = sorted(rng.sample(range(len(body)), 25))
    zstd_file(tmp_path / "x.zst", [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)])] + [b""], skippable_at=4)
    size = (tmp_path / "x.zst").stat().st_size
    with open(tmp_path / "x.zst", "rb") as source:
        got = [line for at in range(0, size, split) for line in zstd_lines.lines(source, at, min(at + split, size), size)]
    assert got == body.split(b"\n")


def test_zstd_stored_signs_are_no_frames(tmp_path):
    """Raw blocks may hold the sign of a frame, even a whole frame."""
    inner = zstandard.ZstdCompressor().compress(b"inner\n" * 3)
    noise = bytes(random.Random(1).randbytes(3_000))
    frames = [b"a\n" + noise.replace(b"\n", b"") + inner.replace(b"\n", b"") + b"\nb", b"c\nd\n"]
    zstd_file(tmp_path / "x.zst", frames)
    whole = b"".join(frames).split(b"\n")[:-1]
    size = (tmp_path / "x.zst").stat().st_size
    with open(tmp_path / "x.zst", "rb") as source:
        assert [x for at in range(0, size, 50) for x in zstd_lines.lines(source, at, min(at + 50, size), size)] == whole


def test_zstd_cut_off_file_is_an_error(tmp_path):
    zstd_file(tmp_path / "x.zst", [b"some line\n" * 100])
    data = (tmp_path / "x.zst").read_bytes()[:-6]
    (tmp_path / "x.zst").write_bytes(data)
    with open(tmp_path / "x.zst", "rb") as source, pytest.raises(EOFError):
        list(zstd_lines.lines(source, 0, len(data), len(data)))


def test_zstd_json_lines(spark, tmp_path):
    lines = [b'{"text": "a", "content": "b"}', b"", b'{"text": "", "content": "c"}', b'{"other": 1}', b"not json", b"   ", b'{"text": "bad \xff byte"}', b'{"content": "d"}']
    body = b"\n".join(lines)
    zstd_file(tmp_path / "x.jsonl.zst", [body[i : i + 17] for i in range(0, len(body), 17)])
    path = str(tmp_path / "x.jsonl.zst")
    for split in (30, 1 << 20):
        assert sorted(r.text for r in text.read_jsonl_text(spark, path, split_bytes=split).collect()) == ["a", "bad \ufffd byte", "c", "d"]
    assert sorted(r.text for r in text.read_jsonl_text(spark, path, ("content", "text")).collect()) == ["b", "bad \ufffd byte", "c", "d"]
    (tmp_path / "none.zst").mkdir()
    assert text.read_jsonl_text(spark, str(tmp_path / "none.zst")).count() == 0
    with pytest.raises(Exception):
        text.read_jsonl_text(spark, str(tmp_path / "missing.zst")).count()


def test_zstd_files_are_written_and_split(spark, tmp_path):
    path = "file://" + str(tmp_path / "out.zst")
    zstd_lines.register(spark)
    rows = spark.range(20_000).select(F.concat(F.lit("line "), F.md5(F.col("id").cast("string"))).alias("value")).repartition(3)
    for mode, copies in (("append", 1), ("append", 2), ("overwrite", 1)):
        rows.write.format(zstd_lines.FORMAT).mode(mode).option("frameBytes", 10_000).save(path)
        back = spark.read.format(zstd_lines.FORMAT).option("splitBytes", 20_000).load(path)
        assert back.count() == 20_000 * copies and back.distinct().count() == 20_000
    assert back.rdd.getNumPartitions() > 6 and len(list((tmp_path / "out.zst").iterdir())) == 3


def test_text_column_choice(spark):
    df = spark.createDataFrame([("x", "y")], "content string, func_code_string string")
    assert text.normalize_text_column(df).first().text == "x"
    with pytest.raises(ValueError):
        text.normalize_text_column(spark.range(1))


def test_cap_per_file(spark, tmp_path):
    for part in (0, 1):
        spark.range(50).select(F.concat(F.lit(f"{part}-"), F.col("id").cast("string")).alias("text")).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    got = sorted(r.text for r in text.read_text(spark, str(tmp_path / "d"), 3).collect())
    assert got == ["0-0", "0-1", "0-2", "1-0", "1-1", "1-2"]


def test_incremental_build_resumes(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    docs = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.concat(F.lit("doc "), F.col("id").cast("string")).alias("text")).coalesce(1)
    docs(0, 5).write.parquet(src)
    assert incremental.build_incremental(spark, src, dst) == 1
    before = spark.read.parquet(f"{dst}/units").count()
    assert incremental.build_incremental(spark, src, dst) == 0
    docs(5, 9).write.mode("append").parquet(src)
    assert incremental.build_incremental(spark, src, dst) == 1
    assert spark.read.parquet(f"{dst}/units").select("doc_id").distinct().count() == 9
    assert spark.read.parquet(f"{dst}/units").count() > before
    assert incremental.build_incremental(spark, str(tmp_path / "gone"), dst) == 0


def test_incremental_build_of_an_emptied_file(spark, tmp_path):
    src, dst = tmp_path / "src", str(tmp_path / "dst")
    write = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("overwrite").parquet(str(src))
    write([(1, "a b"), (2, "c d")])
    assert incremental.build_incremental(spark, str(src), dst) == 1
    # The same file name, now without any text.
    file = next(p for p in src.iterdir() if p.name.startswith("part-") and p.suffix == ".parquet")
    spark.createDataFrame([(1, ""), (2, None), (3, "")], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "new"))
    fresh = next(p for p in (tmp_path / "new").iterdir() if p.name.startswith("part-") and p.suffix == ".parquet")
    file.write_bytes(fresh.read_bytes())
    for crc in src.glob(".part-*.crc"):
        crc.unlink()
    assert incremental.build_incremental(spark, str(src), dst) == 1
    assert not list((tmp_path / "dst" / "units").glob("shard=*"))


def test_incremental_build_knows_files_by_path(spark, tmp_path):
    import shutil

    src, dst = tmp_path / "src", str(tmp_path / "dst")
    made = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.concat(F.lit("doc "), F.col("id").cast("string")).alias("text")).coalesce(1)

    def put(lo, hi, place):
        made(lo, hi).write.mode("overwrite").parquet(str(tmp_path / "tmp"))
        (src / place).parent.mkdir(parents=True, exist_ok=True)
        shutil.copy(next((tmp_path / "tmp").glob("part-*.parquet")), src / place)

    stored = lambda: sorted(r.doc_id for r in spark.read.parquet(f"{dst}/units").select("doc_id").distinct().collect())
    put(0, 3, "p=a/x.parquet")
    put(3, 5, "p=b/x.parquet")  # clashes in the same run
    put(5, 6, "top.parquet")
    assert incremental.build_incremental(spark, str(src), dst) == 3 and stored() == list(range(6))
    put(6, 9, "p=c/deep er/x.parquet")  # clashes in a later run
    assert incremental.build_incremental(spark, str(src), dst) == 1 and stored() == list(range(9))
    put(20, 24, "p=b/x.parquet")  # changed
    assert incremental.build_incremental(spark, str(src), dst) == 1 and stored() == [0, 1, 2, 5, 6, 7, 8, 20, 21, 22, 23]
    assert incremental.build_incremental(spark, str(src), dst) == 0


def test_run_log_and_metrics(spark, tmp_path):
    body = ['{"step": 1, "loss": 2.5}', "", "garbage", 'rank0 {"step": 2, "loss": 2.0, "lr": 0.1}', '{"step": 3, "event": "spike_skip"}', "{broken"]
    (tmp_path / "a.log").write_text("\n".join(body))
    got = sorted((r.step, r.loss) for r in logs.read_run_log(logs.read_lines(spark, str(tmp_path / "a.log"))).collect())
    assert got == [(1, 2.5), (2, 2.0)]
    (tmp_path / "m.log").write_text("12:00 | eval nll=-3.25\neval nll=9\nnothing\n")
    found = logs.extract_metrics(logs.read_lines(spark, str(tmp_path / "m.log")), {"nll": r"eval nll=(-?\d+(?:\.\d+)?)"})
    assert [(r.metric, r.value) for r in found.collect()] == [("nll", -3.25)]


def test_sections(sliced, tmp_path):
    body = ["lost", "==================== prompt 1: first ==========", "lost too", "--- a ---", "one", "[marker]", "", "two", "--- b ---",
            "==================== prompt 2: second ==========", "not in a readout", "--- a ---", "three"]
    (tmp_path / "g.log").write_text("\n".join(body))
    got = {(r.prompt_id, r.title, r.readout): r.text for r in logs.parse_sections(logs.read_lines(sliced, str(tmp_path / "g.log"))).collect()}
    assert got == {(1, "first", "a"): "one\ntwo", (2, "second", "a"): "three"}


def test_stream_spikes_equal_batch(spark, tmp_path):
    rows = [("r", i, float(1 + (i % 7) + (40 if i % 13 == 0 else 0))) for i in range(120)]
    df = spark.createDataFrame(rows, "name string, step bigint, value double").select(F.lit(1).cast("bigint").alias("run"), "step", "value")
    src = str(tmp_path / "src")
    checkpoint, dst = str(tmp_path / "c"), str(tmp_path / "dst")
    for lo in (0, 60):  # two deliveries, state carried between them
        df.filter((F.col("step") >= lo) & (F.col("step") < lo + 60)).coalesce(1).write.mode("append").parquet(src)
        log = jobs.file_stream(spark, src, "run BIGINT, step BIGINT, value DOUBLE")
        jobs.write_batches(jobs.stream_spikes(log, 3.0, 0.0, 20, 5), dst, checkpoint)
    stream = {r.step: r.spike for r in spark.read.parquet(dst).collect()}
    batch = {r.step: r.spike for r in rl.spike_flags(df, 3.0, 0.0, 20, 5).collect()}
    assert stream == batch and any(batch.values())


def test_watermarked_drop_seen(spark, tmp_path):
    rows = [(i % 6, f"2024-01-01 00:{i:02d}:00") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, at string").withColumn("ts", F.to_timestamp("at")).drop("at")
    df.write.parquet(str(tmp_path / "s"))
    from unitloom.operators.mixing import build_seen_ids

    seen = build_seen_ids(spark.createDataFrame([(0,), (1,)], "doc_id bigint"), "doc_id")
    stream = jobs.file_stream(spark, str(tmp_path / "s"), "doc_id BIGINT, ts TIMESTAMP")
    query = jobs.write_batches(jobs.stream_drop_seen(stream, seen, "doc_id", "ts"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [2, 3, 4, 5]
    assert sum(p["rows"] for p in jobs.ingest_progress(query)) == 12
