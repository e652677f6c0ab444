"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, licences, linededup, merkle, mixing, near, packing, pages, quality, repair, tokens, topk, toxicity
from .common import read_table


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_components(read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_power_of_two(read_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return topk.top_k_inner(rows.filter(F.col("vec_id") % 50 == 0), rows, k=5)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(read_table(spark, sf_dir, "pages"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(read_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_filter(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


#: Weights of the quality classes 1 and 0 of the labelled table.
MIX_TARGETS = {"1": 0.9, "0": 0.1}


def mix_domains(labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing queries: domains are the quality classes."""
    return labels.select("doc_id", F.col("quality").cast("string").alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mix = mixing.fit_mixture(docs, mix_domains(read_table(spark, sf_dir, "labels")), MIX_TARGETS)
    return mixing.document_rates(docs, mix)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_frequent_lines(read_table(spark, sf_dir, "documents"), least=10, shortest=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(read_table(spark, sf_dir, "conversations"), damage=True)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered={"text": merkle.lowered_fifth(docs)})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_licence_scan": op6_licence_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_topk_search": op8_topk_search,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _crc32(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of an ASCII text."""
    shifts = ", ".join(["-1"] * 8)
    step = "case when v >= 0 then xor(a, v) else xor(a >> 1, (a & 1) * 3988292384) end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::bigint, {shifts}]))), lambda a, v: {step}), 4294967295)"


def _tree(name: str, leaves: str, levels: int) -> str:
    """DuckDB CTEs of a tree over (g, i, n, h): its levels name_0, name_1, ... and name_top."""
    made = [f"{name}_0 as ({leaves})"]
    for k in range(levels):
        made.append(f"""{name}_{k + 1} as (select g, i // 16 as i, (n + 15) // 16 as n, sha256(string_agg(h, '' order by i)) as h
            from {name}_{k} where n > 1 group by g, i // 16, n)""")
    tops = " union all ".join(f"select g, h from {name}_{k} where n = 1" for k in range(levels + 1))
    return ",\n".join([*made, f"{name}_top as ({tops})"])


def _fold(name: str, levels: int, start: str) -> str:
    """DuckDB CTEs that take rows of `start` (g, i, x, y, proof, ...) up a tree; y is folded, x their own node."""
    made = [f"{name}_up_0 as ({start})"]
    for k in range(levels):
        made.append(f"""{name}_run_{k} as (select g, i // 16 as p, list(h order by i) as hs from {name}_{k} where n > 1 group by g, i // 16),
        {name}_up_{k + 1} as (select u.* replace (u.i // 16 as i, case when hs is null then y
                else sha256(array_to_string(hs[:u.i % 16], '') || y || array_to_string(hs[u.i % 16 + 2:], '')) end as y,
                proof || case when hs is null then '' else array_to_string(hs[:u.i % 16], '') || array_to_string(hs[u.i % 16 + 2:], '') end as proof)
            from {name}_up_{k} u left join {name}_run_{k} r on r.g is not distinct from u.g and r.p = u.i // 16)""")
    return ",\n".join(made)


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({v}::varchar)::varchar || ':' || {v}::varchar, '-')" for v in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_TAMPERED = f"""case when {_crc32("doc_id::varchar")} % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end"""

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = min(doc_id) over g as kept, text_sha256
        from t window g as (partition by text_sha256)
    """,
    "op8_topk_search": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
                   where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
                   from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
             r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, rank::int as rank, vec_id, score from r where rank <= 5
    """,
    "op11_line_dedup": """
        with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
        l as (select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as spot from d),
        k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
        f as (select key from k where key <> '' group by key having count(distinct r) >= 10)
        select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by spot) filter (f.key is null), '')) as kept_sha256
        from k left join f on f.key = k.key group by r, doc_id
    """,
    # rows one by one, with the best edits for each place in the order of roles
    "op12_conversation_repair": rf"""
        with recursive base as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   {_crc32("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as hit from conversations),
        damaged as (
            select conv_id, turn, case hit when 4 then 'user' else role end as role, unnest(range(case hit when 0 then 0 when 3 then 2 else 1 end)) as copy,
                   case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from base),
        numbered as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(length(role) || ':' || role || text)) as n,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as tail from damaged),
        seen as (select *, row_number() over (partition by conv_id, role, text order by n) as time from numbered),
        rows_ as (
            select *, left(role, 1) as i, case when tail = '' then 'blank' when time > 1 then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' end as fault,
                   lag(left(role, 1)) over (partition by conv_id order by n) as before from seen),
        ins(p, q, c, a) as (values (0,0,0,''), (0,2,3,'I'), (0,3,6,'II'), (1,1,0,''), (1,2,3,'I'), (1,3,6,'II'), (2,2,0,''), (2,3,3,'I'), (3,3,0,''), (3,2,3,'I')),
        ops(p, q, c, a, i) as (values (0,0,4,'D',''), (1,1,4,'D',''), (2,2,4,'D',''), (3,3,4,'D',''), (0,2,3,'R',''), (1,2,3,'R',''), (3,2,3,'R',''), (2,3,3,'R',''),
                                      (0,1,0,'K','s'), (0,2,0,'K','u'), (1,2,0,'K','u'), (3,2,0,'K','u'), (2,3,0,'K','a')),
        ids as (select distinct conv_id from conversations),
        best as (
            select conv_id, 0::bigint as n, 0 as p, 0::bigint as cost, '' as audit from ids
            union all
            select conv_id, n, p, cost, audit from (
                select *, row_number() over (partition by conv_id, p order by cost, audit) as k from (
                    select b.conv_id, b.n + 1 as n, o.q as p, b.audit || e.a || o.a as audit,
                           b.cost + e.c + o.c + case when r.fault = 'truncated' and o.a <> 'D' then 3 else 0 end as cost
                    from best b join rows_ r on r.conv_id is not distinct from b.conv_id and r.n = b.n + 1
                    join ins e on e.p = b.p join ops o on o.p = e.q and (o.i = '' or o.i = r.i) and (o.a = 'D' or coalesce(r.fault, '') not in ('blank', 'duplicate'))))
            where k = 1),
        ended as (
            select conv_id, min((b.cost + e.c, b.audit || e.a)) as x, max(n) as n from best b join ins e on e.p = b.p and e.q in (0, 3)
            where n = (select count(*) from rows_ r where r.conv_id is not distinct from b.conv_id) group by conv_id),
        edits as (
            select conv_id, spot, x[2][spot] as op, len(replace(x[2][:spot], 'I', '')) as n, len(replace(x[2][:spot], 'D', '')) as m
            from (select conv_id, x, unnest(range(1, len(x[2]) + 1)) as spot from ended)),
        written as (
            select e.conv_id, e.spot, e.op, e.m, r.role, r.text, max(case when e.m = 1 and e.op = 'K' and r.i = 's' then 1 else 0 end) over (partition by e.conv_id) as s
            from edits e left join rows_ r on e.op <> 'I' and r.conv_id is not distinct from e.conv_id and r.n = e.n where e.op <> 'D'),
        repaired as (
            select conv_id, string_agg(case when op = 'K' then role when (m - s) % 2 = 1 then 'user' else 'assistant' end || ':' || case when op = 'I' then '' else text end, chr(10) order by spot) as t
            from written group by conv_id),
        counts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                   count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal from rows_ group by conv_id)
        select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, x[1]::bigint as cost, x[2] as audit, sha256(coalesce(t, '')) as repaired_sha256
        from ids join ended on ended.conv_id is not distinct from ids.conv_id left join counts on counts.conv_id is not distinct from ids.conv_id
        left join repaired on repaired.conv_id is not distinct from ids.conv_id
    """,
    # a tree of up to 16^6 leaves for each source, and of up to 16^4 sources
    "op13_merkle_manifest": f"""
        with leaves as materialized (
            select doc_id, source as g, {_LEAF.format(text="text")} as h, {_LEAF.format(text=_TAMPERED)} as other,
                   row_number() over (partition by source order by doc_id nulls first, {_LEAF.format(text="text")}) - 1 as i, count(*) over (partition by source) as n from documents),
        {_tree("leaf", "select g, i, n, h from leaves", 6)},
        {_tree("src", "select 0 as g, row_number() over (order by g nulls first) - 1 as i, count(*) over () as n, h, g as source from leaf_top", 4)},
        {_fold("leaf", 6, "select doc_id, g, i, h as x, other as y, '' as proof from leaves")},
        {_fold("src", 4, "select u.doc_id, s.g, s.i, u.x, u.y, u.proof, s.h as subroot from leaf_up_6 u join src_0 s on s.source is not distinct from u.g")}
        select doc_id, x as leaf, subroot, t.h as root, sha256(proof) as proof_sha256, y as folded_root, y = t.h as verified from src_up_4, src_top t
    """,
}
