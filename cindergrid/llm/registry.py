"""Queries that apply the operators, with production parameters, to whole tables."""

import hashlib
import zlib

from pyspark.sql import functions as F

from cindergrid.llm import ann, bpe, chat, decontam, langid, linededup, lm, minhash, negatives, packing, periodic, pii, quality

QUERIES, ORACLES = {}, {}


def op(f):
    QUERIES[f.__name__] = f
    return f


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n):
    return F.crc32(F.col("doc_id").cast("string")) % n


@op
def op2_error_correcting_language(spark, sf_dir):
    docs, held = read(spark, sf_dir, "documents"), F.coalesce(remainder(3) == 1, F.lit(False))
    return langid.predict(docs, langid.fit(docs, ~held)).withColumn("held_out", held)


@op
def op5_byte_cnn_quality(spark, sf_dir):
    docs, held = read(spark, sf_dir, "documents"), F.coalesce(remainder(4) == 2, F.lit(False))
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, read(spark, sf_dir, "labels"), ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@op
def op6_dart_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@op
def op8_chat_templates(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -1L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")

    def start():
        return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

    def add(state, part):
        text = part["formatted"]
        state["chars"] += len(text)
        for r, t in chat.read_back(text):
            state["n"] += 1
            state["turns"].update(f"{r}\n{t}\n".encode())
        for s in part["loss_spans"]:
            loss = chat.unescape(text[s["start"]:s["end"]])
            state["loss"].update(loss.encode())
            state["loss_chars"] += len(loss)

    def finish(conv, state):
        return conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]
    return chat.whole(chat.format_conversations(rows.union(extra)), start, add, finish, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@op
def op10_best_two_fit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), ids=False)


@op
def op3_seed_and_align(spark, sf_dir):
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@op
def op4_semi_markov_pii(spark, sf_dir):
    def line(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = pii.find(read(spark, sf_dir, "documents"))
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *n, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


@op
def op1_learned_partitions(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter("vec_id % 20 = 0"))


@op
def op7_prefix_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(read(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


@op
def op9_hashed_maxent_scores(spark, sf_dir):
    return lm.score(read(spark, sf_dir, "documents"), remainder(7) == 2)


@op
def op13_sentencepiece_byte_bpe(spark, sf_dir):
    spec = bpe.codec_spec()
    decoded = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), spec), spec)
    return decoded.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@op
def op11_repeated_gram_runs(spark, sf_dir):
    def words(doc_id, text):
        """The words, of which those of one document in ten are made periodic from a place on."""
        own, h = periodic.words_of(doc_id, text), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or not own:
            return own
        n, g = len(own), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return own[:a] + [own[a + (i - a) % p] for i in range(a, n)]
    found = periodic.find_runs(read(spark, sf_dir, "documents"), words)
    best = "aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (b, r) -> case when b is null or r.length * b.period > b.length * r.period then r else b end)"
    found = found.select("*", F.size("runs").cast("long").alias("n_runs"), F.expr(best).alias("best"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


@op
def op12_dual_tree_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end").alias("label"))
    return negatives.mine(rows, F.expr("vec_id % 100 = 0"))
