"""Raw archives: the reader, record checks, carry-forward and extraction."""

import gzip
import os
import pickle
import random

import pytest
from pyspark.sql import functions as F

from ambilens.operators import archive
from ambilens.plans import extract
from ambilens.sources.archive import list_archives


class Planted:
    def __reduce__(self):
        return (os.getenv, ("HOME",))


def metadata(model="org/M-1", **config):
    return {"type": "metadata", "created_at": 1.5, "hostname": "h",
            "config": {"model": model, "model_type": "base", "dataset": "D", **config}}


def candidate(text, reason="stop", **extra):
    return {"text": text, "finish_reason": reason, "stop_reason": None, **extra}


def batch(start, texts, **extra):
    samples = [{"index": start + i, "row_number": start + i + 2, "src": f"s{start + i}", "ambiguity": i % 2,
                "prompt": "p", "candidates": [candidate(t) for t in group], **extra}
               for i, group in enumerate(texts)]
    return {"type": "batch", "start_index": start, "end_index": start + len(samples), "samples": samples}


def write(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as raw:
        for record in records:
            with gzip.GzipFile(fileobj=raw, mode="wb") as member:
                pickle.dump(record, member)
    return path


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "raw"
    write(root / "p/D/m_1.pkl.gz", metadata(), batch(0, [['a"', "b\nc"], ["d"]]), batch(2, [["e Note: f"]]))
    write(root / "p/D/m_2.pkl.gz", metadata("org/M-2"), batch(0, [['a"'], []]))
    write(root / "top.pkl.gz", metadata("x"))
    write(root / "bad/early.pkl.gz", batch(0, [["q"]]), metadata())
    write(root / "bad/none.pkl.gz")
    wide = batch(0, [["w"]])
    wide["samples"][0]["ambiguity"] = 300
    write(root / "bad/wide.pkl.gz", metadata(), wide)
    write(root / "bad/kind.pkl.gz", metadata(), {"type": "other"})
    write(root / "bad/config.pkl.gz", {"type": "metadata", "config": "text"})
    write(root / "bad/list.pkl.gz", metadata(), batch(0, [["kept?"]]), [1, 2])
    write(root / "bad/code.pkl.gz", metadata(), {"type": "batch", "samples": [], "x": Planted()})
    (root / "bad/cut.pkl.gz").write_bytes(write(tmp_path / "w.pkl.gz", metadata(), batch(0, [["z"]])).read_bytes()[:-20])
    (root / "other.txt").write_text("x")
    return root


def test_listing(tree):
    names = [os.path.basename(p) for p, _ in list_archives(str(tree))]
    assert len(names) == 11 and names[-2:] == ["m_2.pkl.gz", "top.pkl.gz"]
    with pytest.raises(FileNotFoundError):
        list_archives(str(tree / "nowhere"))


def test_extraction(spark, tree, tmp_path, rows):
    out = str(tmp_path / "out")
    status = extract.extract_archives(spark, str(tree), out)
    found = {os.path.relpath(r.path, tree): (r.status, r.n_rows, r.n_samples, r.error) for r in status.collect()}
    assert found["p/D/m_1.pkl.gz"] == ("written", 4, 3, None)
    assert found["p/D/m_2.pkl.gz"] == ("written", 1, 2, None)
    assert found["top.pkl.gz"] == ("written", 0, 0, None)
    reasons = {k: v[3] for k, v in found.items() if v[0] == "failed"}
    assert reasons["bad/early.pkl.gz"] == "batch before metadata"
    assert reasons["bad/none.pkl.gz"] == "no metadata record"
    assert reasons["bad/kind.pkl.gz"] == "unsupported record type"
    assert reasons["bad/config.pkl.gz"] == "invalid metadata config"
    assert "dictionary" in reasons["bad/list.pkl.gz"]
    assert "300 is no 8-bit integer" in reasons["bad/wide.pkl.gz"]
    assert "Refused to load" in reasons["bad/code.pkl.gz"]
    assert reasons["bad/cut.pkl.gz"].startswith("unreadable record")

    table = extract.read_candidates(spark, out)
    assert rows(table, "folder", "model_tag", "source_index", "row_number", "source_text", "ambiguity",
                "model", "model_type", "candidate_index", "raw_text", "processed_text", "finish_reason") == [
        ("p/D", "m_1", 0, 2, "s0", 0, "org/M-1", "base", 0, 'a"', "a", "stop"),
        ("p/D", "m_1", 0, 2, "s0", 0, "org/M-1", "base", 1, "b\nc", "b", "stop"),
        ("p/D", "m_1", 1, 3, "s1", 1, "org/M-1", "base", 0, "d", "d", "stop"),
        ("p/D", "m_1", 2, 4, "s2", 0, "org/M-1", "base", 0, "e Note: f", "e", "stop"),
        ("p/D", "m_2", 0, 2, "s0", 0, "org/M-2", "base", 0, 'a"', "a", "stop")]

    again = extract.extract_archives(spark, str(tree), out)
    counts = {r.status: r.n_files for r in extract.status_summary(again).collect()}
    assert counts == {"skipped": 3, "failed": 8}
    assert extract.read_candidates(spark, out).count() == 5

    write(tree / "p/D/m_1.pkl.gz", metadata(), batch(0, [["new"]]))
    write(tree / "p/D/m_2.pkl.gz", metadata())
    extract.extract_archives(spark, str(tree), out, overwrite=True)
    assert rows(extract.read_candidates(spark, out), "model_tag", "raw_text") == [("m_1", "new")]


def test_candidate_defaults(spark, tmp_path, rows):
    root = tmp_path / "raw"
    odd = {"type": "batch", "samples": [
        {"index": 0, "row_number": 2, "ambiguity": 1, "candidates": [
            {}, candidate(12, None), candidate(None, 7), candidate("ok")]},
        {"index": 1}]}
    write(root / "a.pkl.gz", metadata(model_type=None), odd)
    extract.extract_archives(spark, str(root), str(tmp_path / "out"))
    table = extract.read_candidates(spark, str(tmp_path / "out"))
    assert rows(table, "candidate_index", "source_text", "raw_text", "processed_text", "finish_reason",
                "model_type", "folder") == [
        (0, "", "", "", None, "None", "."), (1, "", "12", "", None, "None", "."),
        (2, "", "None", "", "7", "None", "."), (3, "", "ok", "ok", "stop", "None", ".")]


def test_nothing_to_extract(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    with pytest.raises(FileNotFoundError):
        extract.extract_archives(spark, str(tmp_path / "raw"), str(tmp_path / "out"))


def test_token_payload(spark, tmp_path):
    token = {"token_id": 3, "token": "x", "sampled_logprob": -0.5,
             "top": [{"token_id": 3, "token": "x", "logprob": -0.5, "rank": 1}]}
    full = candidate("t", cumulative_logprob=-1.0, token_ids=[3, 4],
                     tokens=[token, {"token_id": 4, "token": "y", "sampled_logprob": None, "top": None}])
    write(tmp_path / "a.pkl.gz", metadata(), {"type": "batch", "start_index": 0, "end_index": 1, "samples": [
        {"index": 0, "src": "s", "ambiguity": 0, "prompt": "P", "candidates": [full]}]})
    records = extract.read_records(spark, str(tmp_path), tokens=True)
    row = records.where("type = 'batch'").first()
    got = row.samples[0].candidates[0]
    assert row.samples[0].prompt == "P" and (row.start_index, row.end_index) == (0, 1)
    assert got.token_ids == [3, 4] and got.tokens[0].top[0].rank == 1 and got.tokens[1].top is None
    meta = records.where("type = 'metadata'").first()
    assert meta.created_at == 1.5 and '"dataset": "D"' in meta.config.json


@pytest.mark.parametrize("split", [200, 1000, 5000])
def test_split_files_read_the_same(spark, tmp_path, rows, split):
    rng = random.Random(5)
    noise = lambda: "".join(rng.choice("abcdef\x1f是") for _ in range(rng.randint(0, 900)))
    records = [metadata("a")]
    for i in range(40):
        if i % 13 == 12:
            records.append(metadata(f"m{i}"))
        records.append(batch(i, [[noise() for _ in range(3)]]))
    write(tmp_path / "raw/big.pkl.gz", *records)
    columns = ["source_index", "model", "candidate_index", "raw_text"]
    extract.extract_archives(spark, str(tmp_path / "raw"), str(tmp_path / "whole"))
    whole = rows(extract.read_candidates(spark, str(tmp_path / "whole")), *columns)
    extract.extract_archives(spark, str(tmp_path / "raw"), str(tmp_path / "parts"), split_bytes=split)
    assert len(whole) == 120
    assert rows(extract.read_candidates(spark, str(tmp_path / "parts")), *columns) == whole


def packed(*records, level=9):
    """One member with several records."""
    return gzip.compress(b"".join(pickle.dumps(r) for r in records), level)


def sound_parts():
    return [packed(metadata("a"))] + [packed(batch(i, [[f"text {i} " + "xyz" * (i % 5)]])) for i in range(6)]


def cases():
    sound = sound_parts()
    damaged = [bytes(b ^ 0x55 if 12 < i < 20 else b for i, b in enumerate(part)) for part in sound]
    crossing = pickle.dumps(batch(7, [["across members"]]))
    yield "sound", sound
    yield "several records", [packed(metadata("a"), batch(0, [["x"]]), batch(1, [["y"]])), *sound[1:], packed(batch(9, [["z"]]), batch(10, [["w"]]))]
    yield "one member", [packed(metadata("a"), *[batch(i, [[f"t{i}"]]) for i in range(30)])]
    yield "across members", [*sound, gzip.compress(crossing[:40]), gzip.compress(crossing[40:])]
    for at in (0, 1, 3, 6):
        yield f"damaged {at}", sound[:at] + [damaged[at]] + sound[at + 1 :]
    yield "truncated", [*sound[:-1], sound[-1][:-9]]
    yield "refused", [*sound[:3], packed({"type": "batch", "samples": [], "x": Planted()}), *sound[3:]]
    yield "garbage", [*sound, b"\x1f\x8b\x08 and more"]
    yield "padded", [*sound, bytes(30)]


def test_every_split_reads_the_same(spark, tmp_path):
    """Whole files and files cut at every member boundary, and one byte beside it."""
    wanted, sizes = {}, {}
    root = tmp_path / "raw"
    root.mkdir()
    for name, parts in cases():
        (root / f"{name}.pkl.gz").write_bytes(b"".join(parts))
        sizes[name] = {sum(map(len, parts[:n])) + d for n in range(1, len(parts)) for d in (-1, 0, 1)}

    def read(split):
        records = extract.read_records(spark, str(root), split_bytes=split)
        found = {}
        for r in sorted(records.collect(), key=lambda r: (r.path, r.seq)):
            texts = [c.text for s in r.samples or () for c in s.candidates]
            found.setdefault(os.path.basename(r.path), []).append((r.type, texts, r.error))
        return found

    wanted = read(1 << 40)
    assert sum(any(e for *_, e in rows) for rows in wanted.values()) == 7
    for split in sorted(set().union(*sizes.values()))[::9] + [len(sound_parts()[0]), 37]:
        assert read(max(split, 20)) == wanted, split


def test_split_facts_show_what_is_missing(spark, tmp_path):
    from ambilens.sources.archive import FORMAT, register

    for name, parts in cases():
        (tmp_path / f"{name}.pkl.gz").write_bytes(b"".join(parts))
    register(spark)
    loaded = spark.read.format(FORMAT).option("path", str(tmp_path)).option("split_bytes", 90).load()
    broken = {os.path.basename(r.path)[:-7] for r in extract.broken_chains(loaded).collect()}
    assert broken == {name for name, _ in cases()} - {"sound", "several records", "one member"}


def test_filters_reach_the_reader(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    from ambilens.sources.archive import FORMAT, RecordReader, register

    for name in "abc":
        write(tmp_path / f"{name}.pkl.gz", metadata(), *[batch(i, [["x"]]) for i in range(4)])
    one = str(tmp_path / "b.pkl.gz")
    made = []
    real = RecordReader._row
    monkeypatch.setattr(RecordReader, "_row", lambda *args: made.append(1) or real(*args))
    reader = RecordReader({"path": str(tmp_path)})
    kind, more = EqualTo(("type",), "metadata"), GreaterThan(("seq",), 0)
    assert list(reader.pushFilters([In(("path",), (one, "other")), kind, more])) == [kind, more]
    spans = reader.partitions()
    assert [s.path for s in spans] == [one]
    assert [r[2] for s in spans for r in reader.read(s)] == ["metadata"] and len(made) == 1
    register(spark)
    loaded = spark.read.format(FORMAT).option("path", str(tmp_path)).load()
    found = loaded.where((F.col("path") == one) & (F.col("type") == "batch"))
    assert found.count() == 4 and found.rdd.getNumPartitions() == 1


def test_trees_are_listed_by_tasks(spark, tree):
    from ambilens.sources.listing import list_tree

    (tree / "deep/er/x.records").mkdir(parents=True)
    write(tree / "deep/er/x.records/inner.pkl.gz", metadata())
    found = {r.path: (r["size"], r.kind) for r in list_tree(spark, f"{tree}/").collect()}
    assert found.pop(str(tree / "deep/er/x.records")) == (0, "table")
    inner = str(tree / "deep/er/x.records/inner.pkl.gz")
    assert found == {p: (n, "file") for p, n in list_archives(str(tree)) if p != inner}
    top = str(tree / "top.pkl.gz")
    assert [r.path for r in list_tree(spark, top).collect()] == [top]
    assert list_tree(spark, str(tree / "other.txt")).count() == 0
    with pytest.raises(FileNotFoundError):
        list_tree(spark, str(tree / "nowhere"))


def test_spans_cover_each_file_once(spark):
    from ambilens.sources.archive import spans_of

    files = spark.createDataFrame([("a", 10), ("b", 25), ("c", 0), ("d", 30)], "path string, size long")
    spans = sorted(tuple(r) for r in spans_of(files, 10).collect())
    assert spans == [("a", 0, 10, True), ("b", 0, 10, False), ("b", 10, 20, False), ("b", 20, 25, False), ("c", 0, 0, True),
                     ("d", 0, 10, False), ("d", 10, 20, False), ("d", 20, 30, False)]


def test_roots_keep_their_store(tree, spark, tmp_path):
    write(tree / "a/m.pkl.gz", metadata(), batch(0, [["in a"]]))
    write(tree / "b/m.pkl.gz", metadata(), batch(0, [["in b"]]))
    for root in (f"file:{tree}", f"file://{tree}/", str(tree)):
        assert all(p.startswith(root.rstrip("/") + "/") for p, _ in list_archives(root))
        out = str(tmp_path / f"out{len(root)}")
        extract.extract_archives(spark, root, out)
        kept = extract.read_candidates(spark, out).where("model_tag = 'm'")
        assert {(r.folder, r.raw_text) for r in kept.collect()} == {("a", "in a"), ("b", "in b")}
    outside = spark.createDataFrame([("/else/x.pkl.gz",)], "path string")
    with pytest.raises(Exception, match="is not below"):
        outside.select(*extract.mirrored(F.col("path"), str(tree))).collect()


def test_sampled_archives_are_extracted(spark, tmp_path, rows):
    from ambilens.operators.unique import aggregate_candidates
    from ambilens.plans import sampling

    corpus = spark.createDataFrame([(i, i + 2, f"s{i}", i % 2) for i in range(5)],
                                   "index long, row_number long, src string, ambiguity tinyint")
    made = spark.createDataFrame(
        [(i, k, f"text {i} {k % 2}", -1.0, [1], [[(1, "t", -0.5, 1)]], "stop", None) for i in range(5) for k in range(3)],
        "index long, candidate_index int, text string, cumulative_logprob double, token_ids array<int>, "
        "logprobs array<array<struct<token_id:int,token:string,logprob:double,rank:int>>>, "
        "finish_reason string, stop_reason string")
    requests = sampling.translation_requests(corpus, "org/M-Base", "base")
    records = sampling.sample_records(
        sampling.samples(requests, sampling.completion_candidates(made)), {"model": "org/M-Base", "model_type": "base"}, 2)
    with pytest.raises(ValueError):
        sampling.write_archive(records, str(tmp_path / "raw/p/m"))
    sampling.write_archive(records, str(tmp_path / "raw/p/m b+1.records"))
    write(tmp_path / "raw/q.pkl.gz", metadata(), batch(9, [["file"]]))
    status = extract.extract_archives(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert rows(status, "folder", "model_tag", "status", "n_rows", "n_samples") == [
        (".", "q", "written", 1, 1), ("p", "m b+1", "written", 15, 5)]
    assert aggregate_candidates(extract.read_candidates(spark, str(tmp_path / "out"))).count() == 11
    again = extract.extract_archives(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert rows(again, "status") == [("skipped",), ("skipped",)]


RECORDS = "path string, seq bigint, type string, config struct<model:string>, samples array<struct<index:bigint>>"


def carried(records):
    last, out = {}, {}
    for path, seq, kind, config, _ in sorted(records, key=lambda r: r[:2]):
        if kind == "metadata":
            last[path] = config
        else:
            out[path, seq] = last[path][0] if last.get(path) else None
    return out


def test_carry_metadata_both_ways(spark):
    rng = random.Random(6)
    records = []
    for n in range(300):
        path = "hot" if n % 3 == 0 else f"p{rng.randrange(8)}"
        kind = "metadata" if rng.random() < 0.15 else "batch"
        records.append((path, n, kind, (f"m{n}",) if kind == "metadata" else None, []))
    df = spark.createDataFrame(records, RECORDS).repartition(5)
    want = carried(records)
    for options in ({}, {"broadcast_rows": 1, "chunk": 7}, {"broadcast_rows": 1, "chunk": 1000}):
        got = archive.carry_metadata(df, **options).select("path", "seq", F.col("config.model").alias("m"))
        assert {(r.path, r.seq): r.m for r in got.collect()} == want, options


def test_batch_records(spark):
    samples = spark.range(300).select(
        F.col("id").alias("index"), F.concat(F.lit("s"), "id").alias("src"), (F.col("id") % 2).alias("model"))
    stored = archive.batch_records(samples, 128, keys=["model"]).collect()
    assert len(stored) == 6
    for row in stored:
        indexes = [s["index"] for s in row.samples]
        assert indexes == sorted(indexes) and len(indexes) <= 64
        assert (row.start_index, row.end_index) == (indexes[0], indexes[-1] + 1)
        assert all(s.src == "s%d" % s["index"] for s in row.samples)


def test_nested_tables_flatten_like_archives(spark, tmp_path, rows):
    write(tmp_path / "raw/a.pkl.gz", metadata(), batch(0, [["x", "y"]]))
    records = extract.read_records(spark, str(tmp_path / "raw"))
    records.write.parquet(str(tmp_path / "nested"))
    records.write.json(str(tmp_path / "lines"))
    direct = rows(archive.flatten_candidates(archive.carry_metadata(records)))
    stored = spark.read.parquet(str(tmp_path / "nested"))
    assert rows(archive.flatten_candidates(archive.carry_metadata(stored))) == direct
    lines = spark.read.schema(records.schema).json(str(tmp_path / "lines"))
    assert rows(archive.flatten_candidates(archive.carry_metadata(lines))) == direct
    assert len(direct) == 2


def test_documents_with_nulls_become_archives(spark, tmp_path):
    from ambilens.plans import stored

    rows_in = [(1, "a\nb", None, "s", 3), (2, None, "en", None, None), (None, "x", "en", "s", 1), (3, "c", "en", "s", 1)]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string, lang string, source string, n_chars long")
    assert stored.write_archives(docs, str(tmp_path / "raw")) == 3
    extract.extract_archives(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    found = extract.read_candidates(spark, str(tmp_path / "out"))
    assert sorted((r.folder, r.source_index, r.raw_text) for r in found.collect()) == [
        ("en", 3, "c"), ("none", 1, "a"), ("none", 1, "b")]


def test_a_partition_is_written_by_one_task(spark, tmp_path, monkeypatch):
    """However many tasks read an archive, until it has rows for several files."""
    noise = random.Random(6)
    for name in ("one", "two"):
        texts = [["".join(noise.choice("abcdef") for _ in range(400))] for _ in range(60)]
        write(tmp_path / f"raw/{name}.pkl.gz", metadata(name), *[batch(i, [text]) for i, text in enumerate(texts)])
    files = {}
    for bound in (500, 10):
        monkeypatch.setattr(extract, "ROWS_PER_FILE", bound)
        out = tmp_path / f"out{bound}"
        extract.extract_archives(spark, str(tmp_path / "raw"), str(out), split_bytes=2000)
        assert extract.read_candidates(spark, str(out)).count() == 120
        files[bound] = len(list(out.glob("folder=*/model_tag=one/*.parquet")))
    # Small partitions of a shuffle are put together, so the second bound may give one too.
    assert files[500] == 1 <= files[10] <= 6


def test_overwriting_lists_the_table_only_to_drop_files(spark, tmp_path, monkeypatch, rows):
    """The folders that were written before are listed where an archive has lost its candidates."""
    raw, out, read, seen = tmp_path / "raw", str(tmp_path / "out"), extract.read_or_none, []
    monkeypatch.setattr(extract, "read_or_none", lambda spark, path, schema: seen.append(path) or read(spark, path, schema))
    write(raw / "a.pkl.gz", metadata(), batch(0, [["x"]]))
    write(raw / "b.pkl.gz", metadata(), batch(0, [["y"], ["z"]]))
    extract.extract_archives(spark, str(raw), out)
    write(raw / "a.pkl.gz", metadata(), batch(0, [["new"]]))
    seen.clear()
    extract.extract_archives(spark, str(raw), out, overwrite=True)
    assert out not in seen
    assert rows(extract.read_candidates(spark, out), "model_tag", "raw_text") == [("a", "new"), ("b", "y"), ("b", "z")]
    write(raw / "b.pkl.gz", metadata())
    extract.extract_archives(spark, str(raw), out, overwrite=True)
    assert rows(extract.read_candidates(spark, out), "model_tag", "raw_text") == [("a", "new")]
