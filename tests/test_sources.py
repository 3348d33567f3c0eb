import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import register
from corpusflow.operators import neardup, packing, records, report, select, tokenizer
from corpusflow.sources import files, readers, writers
from corpusflow.streaming import streams


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def test_documents_of_a_mixed_folder(spark, tmp_path):
    put(tmp_path / "a.txt", "one\n\n  two \r\nthree\n \n")
    put(tmp_path / "sub" / "b.jsonl", '"plain"\n{"text": 5, "content": "kept"}\n{"text": " ", "content": "not this"}\n[1]\nbad\n{"tamil": "last"}\n')
    put(tmp_path / "c.md", "not read")
    got = readers.documents(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.text for r in got] == ["one", "two", "three", "plain", "kept", "last"] and [r.ord for r in got] == list(range(6))
    assert [r.text for r in readers.documents(spark, str(tmp_path), limit=2).orderBy("ord").collect()] == ["one", "two"]
    assert [r.text for r in readers.documents(spark, str(tmp_path), line_documents=False).orderBy("ord").collect()][0] == "one\n\n  two \r\nthree"
    assert [r.text for r in readers.documents(spark, str(tmp_path / "c.md")).collect()] == ["not read"]
    with pytest.raises(Exception):
        readers.documents(spark, str(tmp_path / "missing")).collect()


def test_a_file_larger_than_a_split_keeps_its_order(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        put(tmp_path / "a.txt", "".join(f"line {k}\n" for k in range(9000)))
        got = readers.documents(spark, str(tmp_path)).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.text for r in got] == [f"line {k}" for k in range(9000)]


def test_records_and_imports(spark, tmp_path):
    assert readers.records(spark, str(tmp_path / "none.jsonl"), missing_ok=True).collect() == []
    with pytest.raises(Exception):
        readers.records(spark, str(tmp_path / "none.jsonl")).collect()
    put(tmp_path / "r" / "data" / "q.jsonl", '{"text": "from a line", "category": "c"}\n\nno json\n')
    put(tmp_path / "r" / "texts" / "p.txt", "first\n\nsecond\n\n \n")
    put(tmp_path / "r" / "s.json", json.dumps({"texts": [{"body": "inner", "type": "t", "quality_score": 0}]}))
    put(tmp_path / "r" / "deep" / "x.txt", "not found")
    got = readers.collection_folder(spark, str(tmp_path / "r")).collect()
    assert sorted((r.text, r.source, r.quality_score) for r in got) == [("first", "collection", 0.85), ("from a line", "collection-c", 0.85), ("inner", "collection-t", 0.85), ("second", "collection", 0.85)]
    with pytest.raises(FileNotFoundError):
        readers.collection_folder(spark, str(tmp_path / "empty"))
    qa = put(tmp_path / "qa.json", json.dumps({"qa": [{"q": "why", "a": "so"}, {"query": "", "url": "u"}, {"question": "only", "source_url": "s"}]}))
    assert [(r.id, r.text, r.url) for r in readers.question_answers(spark, [qa]).orderBy("id").collect()] == [("qa-qa-0", "why so", None), ("qa-qa-2", "only", "s")]
    assert [r.text for r in readers.phrase_table(spark, str(tmp_path / "no.yaml"), ["long enough phrase", "short"]).collect()] == ["long enough phrase"]


def test_shards_round_trip(spark, tmp_path):
    docs = [[5 + i] * (i * 7 % 13) for i in range(40)]
    packed = packing.pack(spark.createDataFrame(list(enumerate(docs)), "ord long, ids array<int>"), "ids", 8)
    want = {r.seq_id: r.tokens for r in packed.collect()}
    writers.binary_shard(packed, str(tmp_path / "shard"), 8, 70_000)
    assert {r.seq_id: r.tokens for r in writers.read_binary_shard(spark, str(tmp_path / "shard")).collect()} == want
    rows = [want[k] for k in sorted(want)]
    (tmp_path / "bin").mkdir()
    np.array(rows[:9], "<u2").tofile(tmp_path / "bin" / "part-0.bin")
    np.array(rows[9:], "<u2").tofile(tmp_path / "bin" / "part-1.bin")
    assert {r.seq_id: r.tokens for r in readers.shard(spark, str(tmp_path / "bin"), 8).collect()} == dict(enumerate(rows))
    with pytest.raises(Exception, match="another length"):
        writers.binary_shard(packed, str(tmp_path / "bad"), 9, 100)


def test_tokenizer_files_round_trip(spark, tmp_path):
    lines = [(k, t) for k, t in enumerate(["மழை இன்று பெய்தது", "மழை நின்றது", "மழை மழை"] * 2)]
    tok = tokenizer.train(spark.createDataFrame(lines, "ord long, text string"), 430)
    assert [tok.vocab[t] for t in ("<pad>", "<bos>", "<eos>", "<unk>", "<mask>")] == [0, 1, 2, 3, 4]
    tok.to_files(spark, f"{tmp_path}/vocab.json", f"{tmp_path}/merges.txt")
    assert json.loads((tmp_path / "vocab.json").read_text()) == tok.vocab
    assert [tuple(x.split("\t")) for x in (tmp_path / "merges.txt").read_text().split("\n")] == tok.merges
    back = tokenizer.Tokenizer.from_files(spark, f"{tmp_path}/vocab.json", f"{tmp_path}/merges.txt")
    assert (back.vocab, back.merges) == (tok.vocab, tok.merges)
    tok.save(spark, f"{tmp_path}/tables")
    assert tokenizer.Tokenizer.load(spark, f"{tmp_path}/tables").merges == tok.merges
    assert files.listed(spark, str(tmp_path), (".json",)) and not files.exists(spark, f"{tmp_path}/none*")


def test_near_dedup_of_a_stream_keeps_what_the_batches_together_keep(spark, tmp_path):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:59], "new"]), " ".join(reversed(words)), " ".join(words[::2] * 2), " ".join(words), " ".join([*reversed(words[1:]), "w0", "end"])]
    for k in range(3):
        spark.createDataFrame([(i, texts[i]) for i in (2 * k, 2 * k + 1)], "ord long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ord long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = streams.near_dedup_stream(stream, f"{tmp_path}/store").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state")
    writer.start().awaitTermination()
    kept = sorted(r.ord for r in spark.read.schema("ord long, batch long").parquet(f"{tmp_path}/store/kept").collect())
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "ord long, text string, source string")
    assert kept == sorted(r.ord for r in neardup.near_dedup(rows, mode="fast").where("dup_of is null").collect()) and len(kept) == 3


def test_registered_functions(spark):
    register.register(spark)
    got = spark.sql("SELECT aksharas('பட்டம் x') a, quality_score('ab cd') q, size(minhash_sig('hello world')) n, target_fraction('மx') f, norm_key('a b-c') k").first()
    assert got.a == ["ப", "ட்", "ட", "ம்", " ", "x"] and got.q == pytest.approx(0.024) and got.n == 128 and got.f == 0.5 and got.k == "abc"


def test_draws_with_replacement_follow_the_weights(spark):
    rows = spark.createDataFrame([(i, 1.0 if i % 2 else 3.0) for i in range(50)], "ord long, weight double").withColumn("quality_score", F.lit(None).cast("double"))
    got = select.weighted_sample(rows, 49).groupBy("ord").count().collect()
    assert sum(r["count"] for r in got) == 49
    many = {r.ord: r["count"] for r in select.weighted_sample(rows.where("ord < 4"), 3, seed=1).groupBy("ord").count().collect()}
    assert sum(many.values()) == 3 and select.weighted_sample(rows, 50).count() == 50


def test_page_records_and_posts(spark):
    posts = spark.createDataFrame([(0, "p", "s", "மழை இன்று பெய்தது நன்றாக", None, "/x", 3), (1, "q", "s", "short", "மழை இன்று  பெய்தது நன்றாக", None, None)], "ord long, post_id string, subreddit string, title string, selftext string, permalink string, score int")
    said = spark.createDataFrame([(0, "p", "s", "[deleted]", 1), (1, "p", "s", "கடல் அலைகள் கரையை மோதின", 2)], "ord long, post_id string, subreddit string, body string, score int")
    got = sorted((r.record_type, r.post_id, r.upvotes) for r in records.post_records(posts, said).collect())
    assert got == [("comment", "p", 2), ("post_title", "p", 3)]
    rows = spark.createDataFrame([("  மழை <b> ", None, "u")], "text string, source string, url string")
    one = records.page_records(rows).first()
    assert (one.text, one.source, one.lang, one.word_count) == ("மழை b", "unknown", "ta", 2)


def test_pluggable_stemmer_and_pool(spark):
    words = spark.createDataFrame([("running",), ("jumps",), ("sky",)], "word string")
    got = report.boundary_agreement(words, lambda w: w[:3], lambda w: [w[:3], w[3:]] if w != "jumps" else [w]).first()
    assert got.n == 3 and got.agreement == pytest.approx(2 / 3)
    pool = spark.range(30).withColumnRenamed("id", "ord")
    first = [r.ord for r in select.random_rows(pool, 5, seed=3).collect()]
    assert first == [r.ord for r in select.random_rows(pool, 5, seed=3).collect()] and len(set(first)) == 5
