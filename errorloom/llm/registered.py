"""The operators as queries over the given tables, and their SQL."""

from functools import wraps

from pyspark.sql import functions as F

import corpus_pipeline
from errorloom.llm import (
    centroids,
    chat,
    exact_dedup,
    jaccard,
    language,
    mixing,
    packing,
    passages,
    quality,
    repair,
    secrets,
    topk,
    toxicity,
)
from errorloom.llm.common import read, remainder, ship, stored

QUERIES, ORACLE = {}, {}


def registered(name: str, sql: str = ""):
    def add(function):
        @wraps(function)
        def run(spark, sf_dir):
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


@registered(
    "op1_exact_dedup",
    """
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
           doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window same as (partition by coalesce(text, ''))
    """,
)
def op1(spark, sf_dir):
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), whole_rows=False)


CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@registered(
    "op2_chat_format",
    r"""
    with turns as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), escaped as (
      select *, length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>|<SYS>|</SYS>)', '\1\2\\\3', 'g')) as n from turns
    )
    select conv_id, count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
           cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
           cast(sum(length('<|turn|>') + length(role) + 1 + n + length('<|end|>') + 1) as bigint) as formatted_chars
    from escaped group by conv_id
    """,
)
def op2(spark, sf_dir):
    names = ["conv_id", "turn", "role", "text"]
    turns = read(spark, sf_dir, "conversations").select(*names)
    turns = turns.unionByName(spark.createDataFrame(CONTROL_TURNS, "conv_id bigint, turn bigint, role string, text string"))
    return chat.read_back(chat.format_turns(turns, chat.text_parts(F.coalesce("text", F.lit("")))))


@registered("op3_quality")
def op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    held_out = (remainder("doc_id", 3) == 1).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", "predicted")


@registered("op4_secret_scan")
def op4(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"))


@registered("op6_toxicity")
def op6(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    held_out = (remainder("doc_id", 5) == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


@registered(
    "op7_top_k",
    """
    with usable as (
      select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
      from embeddings
      where embedding is not null and vec_id is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
      select q.vec_id as query_id, c.vec_id,
             cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) as bigint) as score
      from usable q, usable c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
    ), ranked as (
      select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
      from scored
    )
    select * from ranked where rank <= 5
    """,
)
def op7(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", topk.integers(F.col("embedding")).alias("vector"))
    return topk.search(rows, rows.where("vec_id % 50 = 0"))


@registered("op8_best_fit_packing")
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(stored(packing.pieces(docs), "pieces"))


@registered("op9_mixing")
def op9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    mixed = mixing.mix(sized, F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@registered("op5_ngram_jaccard")
def op5(spark, sf_dir):
    return jaccard.groups(read(spark, sf_dir, "documents"))


@registered("op10_repeated_passages")
def op10(spark, sf_dir):
    return passages.repeated(read(spark, sf_dir, "documents"))


@registered("op11_language_id")
def op11(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, "lang", remainder("doc_id", 4) != 2)
    held_out = (remainder("doc_id", 4) == 2).alias("held_out")
    return language.label(docs, model).select("doc_id", held_out, "lang_pred", "score", F.size("spans").alias("n_spans"))


def _clustering_sql(k: int, rounds: int) -> str:
    """Rounds of assignment and of new centroids, each a table expression."""
    floor = "cast((s - ((s % n) + n) % n) // n as bigint)"
    parts = [
        """kept as materialized (
          select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
          from embeddings
          where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        )""",
        f"""c0 as materialized (
          select row_number() over (order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as c, v
          from kept qualify c < {k}
        )""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} as materialized (
              select row, vec_id, any_value(kept.v) as v,
                     min(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 64 + c) as best
              from kept cross join c{i} group by row, vec_id
            )"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} as materialized (
                  with sums as (
                    select cast(best % 64 as bigint) as c, dim, sum(v[dim]) as s, count(*) as n
                    from a{i}, range(1, 65) r(dim) group by all
                  ), means as (select c, list({floor} order by dim) as v from sums group by c)
                  select c{i}.c, coalesce(means.v, c{i}.v) as v from c{i} left join means using (c)
                )"""
            )
    return f"""
    with {", ".join(parts)}, assigned as (
      select vec_id, cast(best % 64 as integer) as cluster, cast(best // 64 as bigint) as distance from a{rounds}
    )
    select vec_id, cluster, distance,
           cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
           cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
    from assigned join c{rounds} on c = cluster
    """


@registered("op12_centroid_clustering", _clustering_sql(centroids.CLUSTERS, centroids.ROUNDS))
def op12(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return centroids.cluster(vectors).drop("centroid")


def damaged(turns):
    """The rows with every fault that the contract of op13 plants, and whether a row is left at all."""
    text, role = (F.coalesce(F.col(name), F.lit(" ")) for name in ("text", "role"))
    name = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    draw = F.crc32(F.concat_ws(":", *name).cast("binary")) % 20
    return turns.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (draw != 0).alias("there"), F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


@registered("op13_conversation_repair")
def op13(spark, sf_dir):
    turns = damaged(read(spark, sf_dir, "conversations"))
    audits = stored(repair.audit(turns, F.col("there")), "audits")
    digests = repair.digests(repair.repaired(turns, audits, F.col("there"))).withColumnRenamed("conv_id", "id")
    faults = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return audits.join(digests, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", *faults, "repaired_sha256")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
