"""The registered queries of the corpus operators, with production parameters, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode_decode
from .common import table
from .compression import quality_rules
from .fingerprints import as_text, fingerprints
from .jaccard_join import jaccard_components
from .language import identify_languages
from .line_dedup import drop_repeated_runs
from .merkle import merkle_manifest
from .packing import pack
from .preference import preference_pairs
from .suffix_dedup import remove_repeats
from .toxicity import toxicity_scores
from .warc import archive_round_trip
from .whitening import whiten

VOCABULARY_JSON = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY_LANGUAGES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as place
    from documents),
filled as (
    select doc_id, place, line, row_number() over (partition by doc_id order by place) as k
    from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
runs as (
    select doc_id, k, [line, lead(line, 1) over w, lead(line, 2) over w] as run, lead(k, 2) over w as last
    from filled window w as (partition by doc_id order by k)),
later as (
    select doc_id, k from (
        select doc_id, k, row_number() over (partition by run order by doc_id, k) as nth from runs where last is not null)
    where nth > 1),
gone as (select distinct doc_id, k + i as k from later, (values (0), (1), (2)) as shifts(i))
select l.doc_id, coalesce(string_agg(l.line, chr(10) order by l.place) filter (where g.k is null), '') as text,
       count(*) as n_lines, count(g.k) as n_removed
from lines l
left join filled f on f.doc_id = l.doc_id and f.place = l.place
left join gone g on g.doc_id = f.doc_id and g.k = f.k
group by l.doc_id
"""


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n and 2n + 1 are the chosen and the rejected one of pair n."""
    turns = table(spark, sf_dir, "conversations").select(F.expr("conv_id div 2").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", "role", "text")
    pairs = preference_pairs(turns.filter("side = 0"), turns.filter("side = 1"))
    return pairs.select(
        "pair_id", "n_common", "prompt", "chosen_completion", "rejected_completion",
        *(F.array_join(F.transform(f"{side}_spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",").alias(f"{side}_spans") for side in ("chosen", "rejected")),
    )


OP5_SQL = """
with turns as (
    select conv_id // 2 as pair_id, conv_id % 2 as side, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as place
    from conversations where conv_id is not null and turn is not null),
pairs as (select pair_id from turns group by pair_id having count(distinct side) = 2),
common as (
    select pair_id, min(case when n < 2 or differ then place end) - 1 as found, max(place) as longest
    from (select pair_id, place, count(*) as n, min(role) <> max(role) or min(text) <> max(text) as differ from turns group by pair_id, place)
    group by pair_id),
known as (select pair_id, coalesce(found, longest) as n_common from common join pairs using (pair_id)),
parts as (
    select t.*, k.n_common, '<|' || role || '|>' || chr(10) as head,
           '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) as whole
    from turns t join known k using (pair_id)),
placed as (
    select *, coalesce(sum(case when place > n_common then length(whole) end) over (partition by pair_id, side order by place rows between unbounded preceding and 1 preceding), 0) as before
    from parts),
spans as (select *, cast(before + length(head) as bigint) as a, cast(before + length(head) + length(text) as bigint) as z from placed)
select pair_id, n_common,
       coalesce(string_agg(whole, '' order by place) filter (where side = 0 and place <= n_common), '') as prompt,
       coalesce(string_agg(whole, '' order by place) filter (where side = 0 and place > n_common), '') as chosen_completion,
       coalesce(string_agg(whole, '' order by place) filter (where side = 1 and place > n_common), '') as rejected_completion,
       coalesce(string_agg(a || '-' || z, ',' order by place) filter (where side = 0 and place > n_common and role = 'assistant'), '') as chosen_spans,
       coalesce(string_agg(a || '-' || z, ',' order by place) filter (where side = 1 and place > n_common and role = 'assistant'), '') as rejected_spans
from spans group by pair_id, n_common
"""


def op5_preference_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself up to its last assistant turn, with the last reply of the next conversation (of the first, for the last) in that turn's place."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null").select(F.col("conv_id").alias("pair_id"), "turn", *text)
    turns = turns.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy("turn", "role", "text")).cast("long"))
    own = F.when(F.col("role") == "assistant", F.struct("place", "text"))
    ends = turns.groupBy("pair_id").agg(F.max(own).alias("own"), F.max("place").alias("n")).select("pair_id", F.coalesce("own.place", F.col("n") + 1).alias("last"), F.coalesce("own.text", F.lit("")).alias("reply"), F.floor(F.col("pair_id") / 1000).alias("bucket"))
    # the next id lies in the same thousand of ids or is the least of a later one
    firsts = ends.groupBy("bucket").agg(F.min("pair_id").alias("first"))
    firsts = firsts.select("bucket", F.coalesce(F.lead("first").over(Window.orderBy("bucket")), F.min("first").over(Window.partitionBy())).alias("after"))
    ids = ends.withColumn("lead", F.lead("pair_id").over(Window.partitionBy("bucket").orderBy("pair_id"))).join(firsts, "bucket")
    replies = ids.select("pair_id", "last", F.coalesce("lead", "after").alias("other")).join(ends.select(F.col("pair_id").alias("other"), "reply"), "other")
    chosen = turns.select("pair_id", F.col("place").alias("turn"), "role", "text")
    kept = chosen.join(ends.select("pair_id", "last"), "pair_id").filter("turn < last").drop("last")
    pairs = preference_pairs(chosen, kept.unionByName(replies.select("pair_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text"))))
    return pairs.select(
        "pair_id", "n_common", "prompt", "chosen_completion", "rejected_completion",
        *(F.array_join(F.transform(f"{side}_spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",").alias(f"{side}_spans") for side in ("chosen", "rejected")),
    )


OP5_REPLIES_SQL = """
with base as (
    select conv_id as pair_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as place
    from conversations where conv_id is not null and turn is not null),
ends as (
    select pair_id, coalesce(max(case when role = 'assistant' then place end), max(place) + 1) as last,
           coalesce(arg_max(text, place) filter (where role = 'assistant'), '') as reply
    from base group by 1),
nexts as (select pair_id, last, coalesce(lead(reply) over (order by pair_id), first_value(reply) over (order by pair_id)) as reply from ends),
turns as (
    select pair_id, 0 as side, role, text, place from base
    union all select pair_id, 1, role, text, place from base join nexts using (pair_id) where place < last
    union all select pair_id, 1, 'assistant', reply, last from nexts),
""" + OP5_SQL[OP5_SQL.index("pairs as (") :]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), revisit_bytes=0).drop("url", "body")


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, VOCABULARY_JSON, public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), VOCABULARY_RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), VOCABULARY_LANGUAGES)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def merkle_sql() -> str:
    """The tree by grouping runs of eight, level by level; a row's path by walking up from its leaf. crc32 is computed bit by bit from its polynomial."""

    def field(name: str, value: str) -> str:
        return f"coalesce(strlen({value})::varchar || ':' || {value}, '-')" if name in ("source", "lang", "text") else f"coalesce(length({value}::varchar)::varchar || ':' || {value}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c, text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

    return f"""
with recursive hashed as (
    select doc_id, lang, {leaf("text")} as leaf, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as forged,
           xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
               lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end)), 4294967295::bigint) % 3 = 0 as hit
    from documents),
leaves as (
    select *, coalesce(':' || lang, '-') as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as size from hashed),
low as (
    select 0 as level, tree, idx, size, leaf as hash from leaves
    union all
    select level + 1, tree, idx // 8, (size + 7) // 8, sha256(string_agg(hash, '' order by idx)) from low where size > 1 group by level, tree, idx // 8, size),
subroots as (
    select tree, hash as subroot, row_number() over (order by case when tree = '-' then 0 else 1 end, encode(tree)) - 1 as idx, count(*) over () as size from low where size = 1),
high as (
    select 0 as level, idx, size, subroot as hash from subroots
    union all
    select level + 1, idx // 8, (size + 7) // 8, sha256(string_agg(hash, '' order by idx)) from high where size > 1 group by level, idx // 8, size),
nodes as (
    select level, tree, idx, size, hash from low where size > 1
    union all select 1000 + level, '', idx, size, hash from high where size > 1),
sided as (
    select a.level, a.tree, a.idx, coalesce(string_agg(b.hash, '' order by b.idx) filter (where b.idx < a.idx), '') as l, coalesce(string_agg(b.hash, '' order by b.idx) filter (where b.idx > a.idx), '') as r
    from nodes a join nodes b on a.level = b.level and a.tree = b.tree and a.idx // 8 = b.idx // 8 group by a.level, a.tree, a.idx),
walk as (
    select doc_id, row_number() over () as row, leaf, case when hit then coalesce(forged, leaf) else leaf end as fold, '' as proof, leaves.tree as of_lang, tree as at_tree, idx, 0 as level from leaves
    union all
    select w.doc_id, w.row, w.leaf, case when s.l is null then w.fold else sha256(s.l || w.fold || s.r) end, case when s.l is null then w.proof else w.proof || s.l || s.r end, w.of_lang,
           case when s.l is null then '' else w.at_tree end, case when s.l is null then u.idx else w.idx // 8 end, case when s.l is null then 1000 else w.level + 1 end
    from walk w left join sided s on s.level = w.level and s.tree = w.at_tree and s.idx = w.idx left join subroots u on u.tree = w.of_lang
    where s.l is not null or w.level < 1000),
done as (select *, row_number() over (partition by row order by level desc) as back from walk)
select doc_id, leaf, subroot, (select hash from high where size = 1) as root, sha256(proof) as proof_sha256, fold as folded_root, fold = (select hash from high where size = 1) as verified
from done join subroots on subroots.tree = done.of_lang where back = 1
"""


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_preference": op5_preference,
    "op5_preference_replies": op5_preference_replies,
    "op6_warc": op6_warc,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_language": op12_language,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op5_preference": OP5_SQL, "op5_preference_replies": OP5_REPLIES_SQL, "op13_merkle": merkle_sql()}
