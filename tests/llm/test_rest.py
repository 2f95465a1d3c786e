import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import chat, language_id, mtree, sharding


def test_language_on_held_out_rows(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, 600)
    got = language_id.identify(docs, model).where(language_id.held_out()).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id.identify(odd_docs, model, "p_").collect()}
    assert odd[1].p_lang_pred == odd[2].p_lang_pred == odd[5].p_lang_pred == "und" and odd[1].score == 2.0
    assert language_id.fit(no_docs).langs == [] and language_id.keep_identified(no_docs).count() == 0
    assert language_id.keep_identified(docs, 600).count() > 0.95 * docs.count()


def test_language_scores_are_calibrated_and_reject(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).where(language_id.held_out() & F.col("lang").isNotNull()).collect()
    right = sum(r.lang == r.lang_pred for r in got) / len(got)
    assert right > 0.99 and abs(sum(r.score for r in got) / len(got) - right) < 0.02
    assert sum(r.accepted for r in got) / len(got) >= 1 - 2 * language_id.REJECT_SHARE
    rng = random.Random(1)
    strange = [(i, "".join(chr(0x3041 + rng.randrange(80)) for _ in range(60))) for i in range(100)]
    none = language_id.identify(spark.createDataFrame(strange, "doc_id long, text string"), model).where("accepted").count()
    assert none <= 10


def test_language_sample_is_bounded(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(language_id, "train", lambda texts, langs: taken.append(sorted(zip(langs, texts, strict=True))))
    monkeypatch.setattr(language_id, "held_out", lambda: F.lit(False))
    rows = [(None, "hot", "en")] * 600 + [(7, f"copy {i % 300}", "en") for i in range(600)] + [(i, f"text {i}", "fr") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language_id.fit(docs.repartition(7), 200)
    language_id.fit(docs.coalesce(1), 200)
    assert taken[0] == taken[1]  # however the table is dealt
    by = [[x for lang, x in taken[0] if lang == y] for y in ("en", "fr")]
    assert all(20 < len(set(x)) == len(x) <= 100 for x in by) and by[0].count("hot") <= 1


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK", 40)
    monkeypatch.setattr(mtree, "QUERIES", 5)
    monkeypatch.setattr(mtree, "PAGE", 8)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.integers(-3, 4, (150, 5)) / 4)]
    rows += [(200, None), (201, []), (202, [float("nan")] * 5), (203, [1.0, None, 0.0, 0.0, 0.0]), (None, [0.0] * 5), (204, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in mtree.top_k(df, df.where("vec_id % 20 = 0"), 7).orderBy("rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    v = {i: np.floor(64 * np.array(e)) for i, e in rows[:150]}
    want = {q: sorted(((i, int(v[q] @ v[i])) for i in v if i != q), key=lambda p: (-p[1], p[0]))[:7] for q in v if q % 20 == 0}
    assert got == want
    assert mtree.top_k(df.limit(0), df.limit(0)).count() == 0
    clash = df.withColumns({"id": F.lit("x"), "v": F.lit(0), "b": F.lit(1), "score": F.lit(2.0)})
    assert mtree.top_k(clash, clash.where("vec_id % 20 = 0"), 7).count() == 7 * len(want)


def test_differencing():
    lanes = sharding.differencing([[(w, i)] for i, w in enumerate([8, 7, 6, 5, 4])], 2)
    sums = [sum(w for w, x in zip([8, 7, 6, 5, 4], lanes, strict=True) if x == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2 and sharding.differencing([], 3).size == 0


def plain_differencing(weights, k):
    """Byte sums by the textbook rule over plain lists: join the two partitions of the widest spread, largest with least."""
    parts = [[w] + [0] * (k - 1) for w in weights]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0] if p[0] < p[-1] else p[0] - p[-1])
        a, b = sorted(parts.pop(), reverse=True), sorted(parts.pop())
        parts.append(sorted((x + y for x, y in zip(a, b, strict=True)), reverse=True))
    return sorted(parts[0])


def test_differencing_against_plain_lists():
    for seed in range(5):
        r = random.Random(seed)
        weights = [r.randrange(1 << 40) for _ in range(r.randrange(1, 120))]
        lanes = sharding.differencing([[(w, i)] for i, w in enumerate(weights)], 16)
        sums = [sum(w for w, x in zip(weights, lanes, strict=True) if x == lane) for lane in range(16)]
        assert sorted(sums) == plain_differencing(weights, 16)


def test_shards(spark, odd_docs, no_docs, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "NODE_GROUPS", 300)
    monkeypatch.setattr(sharding, "FAN", 2)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
    r = random.Random(1)
    rows = [(i, "x" * r.randint(0, 400) + str(i % 700)) for i in range(1500)] + [(i, "hot") for i in range(1500, 1800)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for x in got:
        by.setdefault(x.shard, []).append(x)
    assert all(sorted(x.slot for x in xs) == list(range(len(xs))) for xs in by.values())
    sums = [sum(x.size for x in xs) for xs in by.values()]
    assert max(sums) - min(sums) < 0.02 * sum(sums)
    text = dict(rows)
    where: dict = {}
    for x in got:
        assert where.setdefault(text[x.doc_id], x.shard) == x.shard
    assert sharding.assign_shards(odd_docs).count() == odd_docs.count()
    sharding.write_shards(odd_docs, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd_docs.count()
    assert sharding.assign_shards(no_docs).count() == 0


def test_chat(spark, monkeypatch):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hmm = chat.fit(turns)
    out = chat.format_chats(turns, hmm)
    both = out.join(turns, ["conv_id", "turn"]).select(F.avg((F.col("role") == F.col("role_pred")).cast("int"))).first()[0]
    assert both > 0.9 and out.count() == turns.count()
    rows = sorted((r.conv_id, r.turn, r.role_pred) for r in out.collect())
    monkeypatch.setattr(chat, "STRETCH", 2)  # stretches don't change the best path
    assert sorted((r.conv_id, r.turn, r.role_pred) for r in chat.format_chats(turns, hmm).collect()) == rows
    d = [(1, 0, "User: hi?\nmore\nAssistant: sure", "x"), (1, 1, None, None), (None, None, "x", None), (1, 1, None, None)]
    odd = spark.createDataFrame(d, "conv_id long, turn int, text string, c string")
    got = chat.format_chats(odd, hmm).collect()
    assert len(got) == 4
    first = next(r for r in got if r.turn == 0)
    assert [(s.role, s.text) for s in first.segments] == [("user", "hi?\nmore"), ("assistant", "sure")]
    assert first.rendered == "<|user|>\nhi?\nmore\n<|end|>\n<|assistant|>\nsure\n<|end|>"
    assert chat.format_chats(odd.limit(0), hmm).count() == 0


def test_chat_cuts_stretches_by_lines(spark, monkeypatch):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    hmm = chat.fit(turns)
    own = [r.text for r in turns.limit(60).collect()]
    rows = [(i % 2 or None, None if i % 3 else 1, own[i % len(own)]) for i in range(240)] + [(3, 1, own[0])] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn int, text string").repartition(5)
    want = []
    for c in (None, 1, 3):
        texts = [x for t in (None, 1) for x in sorted(r[2] for r in rows if r[0] == c and r[1] == t)]
        paths = [chat.decode(hmm, texts, -1, z) for z in range(3)]
        matrix = None
        for x in texts:
            for i, line in enumerate(chat.lines_of(x)):
                m = hmm.step(line, i == 0)
                matrix = chat._opening(hmm, m) if matrix is None else (matrix[:, None] + m).max(axis=0)
        want += [(str(c), x, chat.ROLES[y[0]]) for x, y in zip(texts, paths[int(matrix.argmax())], strict=True)]
    monkeypatch.setattr(chat, "STRETCH", 8)
    monkeypatch.setattr(chat, "GROUP", 3)  # several levels of matrices
    held: dict = {}
    for r in chat.numbered(df).collect():
        held.setdefault((r.c, r.s), []).append(len(chat.lines_of(r.text)))
    assert max(map(sum, held.values())) <= 8 + max(len(chat.lines_of(x)) for x in own) and len(held) > 20
    got = sorted((str(r.conv_id), r.role_pred) for r in chat.format_chats(df, hmm).collect())
    assert got == sorted((c, y) for c, _, y in want)


def test_chat_rows_where_files_are_split(spark, tmp_path):
    """One row out for each row in, with equal roles, when files between the passes are read in many splits."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "text")
    hot = turns.limit(200).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    rows = turns.unionByName(hot).unionByName(hot)
    hmm = chat.fit(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    key = lambda df: sorted((r.conv_id, r.turn, r.role_pred, r.rendered) for r in df.collect())
    want = key(chat.format_chats(rows, hmm))
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "2048")
    hadoop.set("parquet.page.size", "512")
    for k in held:
        spark.conf.set(k, "2k")
    try:
        got = key(chat.format_chats(rows, hmm))
    finally:
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.page.size")
        for k, v in held.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert len(want) == rows.count() and got == want


def test_subwords_do_not_depend_on_chunks(monkeypatch):
    texts = ["", "12 34", "a", "  Ab1 cd--ef  ", "é" * 30, "1" * 20 + "x y" + "2" * 20, "the cat sat on the mat " * 9]
    def held(t):
        return sorted(np.concatenate([*language_id.subwords(t), np.empty(0, np.int64)]).tolist())
    want = [held(t) for t in texts]
    for chunk in (1, 2, 3, 5, 7):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        assert [held(t) for t in texts] == want
    assert want[0] == want[1] == []
