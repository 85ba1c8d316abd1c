"""One query per operator, over whole tables, and the SQL to check it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfeat.llm import (
    bpe,
    chat,
    collocations,
    exact,
    fingerprints,
    langid,
    lm,
    near,
    negatives,
    packing,
    paragraphs,
    pii,
    quality,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The conversation that every chat query adds: its text holds another template's markers and a backslash.
EXTRA_CONVERSATION = -7
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pii_boosting")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in pii.KINDS],
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )


WORDS_SQL = """
words as (
  select doc_id,
         [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] as w
  from documents)"""


@query(
    "op2_chosen_path",
    f"""with recursive {WORDS_SQL},
shingles as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then []
                                           when len(w) < 4 then [array_to_string(w, ' ')]
                                           else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end)) as s
  from words),
sizes as (select d.doc_id, count(s) as n from documents d left join shingles using (doc_id) group by 1),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c >= 80 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as d, doc_id as r from documents
  union
  select reach.d, edges.b from reach join edges on reach.r = edges.a)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept
from sizes join (select d as doc_id, min(r) as component_id from reach group by 1) using (doc_id)""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"), words=4)


@query("op3_cross_entropy")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ESCAPED = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"

# The template's turn orders as a regular language over the first letters of the roles; z is any other role.
_ROLES = (
    "string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'z' end, '' "
    "order by turn, role, text)"
)
_STATE = f"""case when regexp_full_match({_ROLES}, 's') then 'primed' when regexp_full_match({_ROLES}, 's?(ua)*u') then 'asked'
            when regexp_full_match({_ROLES}, 's?(ua)+') then 'answered' else 'error' end"""


@query(
    "op4_chat_template",
    f"""with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {EXTRA_CONVERSATION}, 0, 'user', '{EXTRA_TEXT}'
  union all select {EXTRA_CONVERSATION}, 1, 'assistant', '{EXTRA_TEXT}')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length('<|start|>') + length(replace({_ESCAPED.format('role')}, chr(10), '<|nl|>')) + 1
                + length({_ESCAPED.format('text')}) + length('<|end|>') + 1) as bigint) as formatted_chars,
       {_STATE} as end_state, {_STATE} = 'answered' as valid
from turns group by conv_id""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(EXTRA_CONVERSATION, 0, "user", EXTRA_TEXT), (EXTRA_CONVERSATION, 1, "assistant", EXTRA_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    made = chat.format_chat(turns.union(extra))
    read = made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "end_state",
        "valid",
    )


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query(
    "op7_exact_recipes",
    """with rows as (
  select doc_id, length(coalesce(text, '')) as n,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm
  from documents),
ranked as (
  select doc_id, sha256(norm) as text_sha256,
         first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id,
         count(*) over (partition by norm) as group_size,
         row_number() over (partition by norm order by n desc, doc_id) = 1 as kept
  from rows)
select doc_id, keep_id, group_size, kept, text_sha256 from ranked""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


@query("op8_repeated_passages")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


@query("op9_trie_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary())
    decoded = bpe.decode(encoded, vocabulary())
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by a checksum of the id as text; never used for learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op10_naive_bayes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query(
    "op11_tree_bounds",
    """with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scores as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label,
         cast(coalesce(list_sum([z[1] * z[2] for z in list_zip(a.v, b.v)]), 0) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0),
positives as (
  select anchor_id, anchor_label, vec_id as positive_id, score as positive_score
  from scores where label = anchor_label and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
         cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as int) as rank
  from positives p join scores s on s.anchor_id = p.anchor_id and s.label <> p.anchor_label
   and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 5""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0, label=label, id_col="vec_id")


def held_out_fifth(doc_id: Column) -> Column:
    """A fifth of the documents, by a checksum of the id as text; their labels are never used for learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op12_ftrl_quality")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~held_out_fifth(F.col("doc_id"))), label=F.col("quality"))
    return quality.score(docs, model).select(
        "doc_id",
        held_out_fifth(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query(
    "op13_suffix_quicksort",
    """with words as (
  select lang, row_number() over () as piece, [x for x in string_split_regex(p, '[\x20\x09]+') if x <> ''] as w
  from (select coalesce(lang, 'und') as lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                   'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
        from documents)),
places as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select unnest(range(1, 6)) as k)),
f as (select lang, k, w[i:i + k - 1] as s, count(*) as c from places group by all),
totals as (select lang, cast(sum(c) as bigint) as n from f where k = 1 group by 1),
candidates as (select * from f where k > 1 and c >= 100),
inner_ones as (
  select distinct x.lang, x.s from candidates x
  join (select lang, c, s[j:j + m - 1] as part
        from (select lang, c, s, m, unnest(range(1, k - m + 2)) as j
              from (select lang, c, s, k, unnest(range(2, k)) as m from candidates))) y
    on x.lang = y.lang and x.s = y.part and 100 * y.c >= 100 * x.c),
cuts as (
  select x.lang, x.s, x.c as a, j, l.c as l, r.c as r, n,
         cast((cast(1000 as hugeint) * x.c * n) // (cast(l.c as hugeint) * r.c) as bigint) as score
  from (select *, unnest(range(1, k)) as j from candidates) x
  join f l on l.lang = x.lang and l.s = x.s[1:j]
  join f r on r.lang = x.lang and r.s = x.s[j + 1:x.k]
  join totals on totals.lang = x.lang
  where not exists (select 1 from inner_ones o where o.lang = x.lang and o.s = x.s)
  qualify row_number() over (partition by x.lang, x.s order by score, j) = 1)
select lang, rank, phrase, a, l, r, n, score
from (select lang, array_to_string(s, ' ') as phrase, a, l, r, n, score,
             cast(row_number() over (partition by lang order by score desc, a desc, array_to_string(s, ' ')) as bigint) as rank
      from cuts)
where rank <= 2000""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
