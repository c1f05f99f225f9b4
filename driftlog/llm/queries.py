"""The registered queries of the numbered operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftlog.llm import (
    balltree, bpe, decontaminate, licenses, lm, merkle, minhash, mixing, quality, simple8b, toxicity, trie, warc,
)
from driftlog.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_ratios(spark: SparkSession, sf_dir: str, docs: DataFrame):
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return quality.train(docs, trusted)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality_ratios(spark, sf_dir, docs))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(warc.locate_records(spark, path), with_payload=False).drop("url")


# Base32 of a digest in SQL: eight letters for every ten hexadecimal digits.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((v >> {shift}) & 31 as integer), 1)"
_EIGHT = " || ".join(_LETTER.format(shift=shift) for shift in range(35, -1, -5))
ORACLES["op2_warc"] = f"""
with named as (
    select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), firsts as (
    select hex, min(page_id) as first_id from named group by hex
), parts as (
    select hex, k, cast('0x' || substr(hex, 10 * k + 1, 10) as bigint) as v
    from firsts, range(4) t(k)
), digests as (
    select hex, string_agg({_EIGHT}, '' order by k) as payload_digest from parts group by hex
)
select n.page_id, strlen(n.html) as payload_bytes, d.payload_digest,
    case when n.page_id = f.first_id then 'response' else 'revisit' end as record_type,
    case when n.page_id = f.first_id then null else f.first_id end as refers_to
from named n join firsts f using (hex) join digests d using (hex)
"""


@query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op6_top_k"] = """
with usable as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id,
        cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
    from usable q join usable c on q.vec_id % 50 = 0 and q.vec_id != c.vec_id and len(q.v) = len(c.v)
), ranked as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
        vec_id, score
    from scored
)
select * from ranked where rank <= 5
"""


@query
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    simple8b.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return simple8b.read_ids(simple8b.locate_files(spark, path), digest=True)


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents")).drop("notices")


@query
def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


# CRC-32 of a decimal number in SQL: one step for each bit of its digits.
_CRC32 = (
    "xor(4294967295, list_reduce(list_concat([cast(4294967295 as bigint)], flatten(list_transform("
    "string_split(cast({id} as varchar), ''), lambda c: [cast(ascii(c) as bigint), 0, 0, 0, 0, 0, 0, 0]))), "
    "lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))))"
)


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_conversation_trie"] = f"""
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
    from conversations where conv_id is not null
), convs as (
    select conv_id, conv_id - conv_id % 20 as source, {_CRC32.format(id="conv_id")} % 4 as h
    from (select distinct conv_id from turns)
), mixed as (
    select c.conv_id, 0 as part, t.p, t.role, t.text from convs c join turns t on t.conv_id = c.source and t.p <= c.h
    union all
    select c.conv_id, 1, t.p, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.p > c.h
), placed as (
    select conv_id, text, role, row_number() over (partition by conv_id order by part, p) as depth from mixed
), steps as (
    select conv_id, depth, text, string_agg(sha256(length(role) || ':' || role || text), '')
        over (partition by conv_id order by depth rows unbounded preceding) as path
    from placed
    union all select conv_id, 0, '', '' from convs
), members as (
    select *, max(depth) over (partition by conv_id) as own_depth from steps
), nodes as (
    select depth, path, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (own_depth = depth), '')) as ends_sha256,
        (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) as own_saved
    from members group by depth, path
), parents as (
    select n.depth, n.path, p.conv_id as parent_conv_id, s.path as parent_path
    from nodes n join steps s on s.conv_id = n.conv_id and s.depth = n.depth - 1
    join nodes p on p.depth = s.depth and p.path = s.path
), children as (
    select depth - 1 as depth, parent_path as path, count(*) as n_children from parents group by all
), sized as (
    select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c using (depth, path)
), sums as (
    select s.depth, s.path, sum(x.own_saved) as saved_tokens, count(*) filter (x.n_children = 0) as n_leaves
    from sized x join steps s on s.conv_id = x.conv_id and s.depth <= x.depth group by s.depth, s.path
)
select n.conv_id, cast(n.depth as bigint) as depth, p.parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
    cast(s.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from sized n join sums s using (depth, path) left join parents p using (depth, path)
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def _leaf(n_chars: str) -> str:
    fields = ["cast(doc_id as varchar)", "source", "lang", f"cast({n_chars} as varchar)", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


# Nodes of all levels of the trees over (tree, pos, digest) rows.
_LEVELS = """
    select tree, 0 as lvl, pos, digest, count(*) over (partition by tree) as n from {leaves}
    union all
    select * from (
        select tree, lvl + 1, pos // 2,
            sha256(digest || coalesce(lead(digest) over (partition by tree order by pos), '')), (n + 1) // 2
        from {levels} where n > 1 qualify pos % 2 = 0
    )
"""
# Siblings of every leaf, level by level: side and digest, or nothing.
_PATHS = """
    select l.tree, l.pos, list(case when s.digest is null then '' when s.pos % 2 = 0 then 'L' || s.digest
        else 'R' || s.digest end order by x.lvl) as path
    from {leaves} l join (select distinct tree, lvl from {levels} where n > 1) x using (tree)
    left join {levels} s on s.tree = l.tree and s.lvl = x.lvl and s.pos = xor(l.pos >> x.lvl, 1)
    group by l.tree, l.pos
"""
ORACLES["op12_merkle_manifest"] = f"""
with recursive hashed as (
    select doc_id, case when lang is null then '' else '=' || lang end as tree, {_leaf("n_chars")} as digest,
        case when doc_id is not null and n_chars is not null and {_CRC32.format(id="doc_id")} % 7 = 0
            then {_leaf("(n_chars + 1)")} end as changed
    from documents
), leaves as (
    select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as pos from hashed
), levels as ({_LEVELS.format(leaves="leaves", levels="levels")}),
subroots as (
    select tree as lang_tree, digest as subroot, '' as tree, row_number() over (order by tree) - 1 as pos, digest
    from levels where n = 1
), top_levels as ({_LEVELS.format(leaves="subroots", levels="top_levels")}),
paths as ({_PATHS.format(leaves="leaves", levels="levels")}),
top_paths as ({_PATHS.format(leaves="subroots", levels="top_levels")}),
proofs as (
    select l.doc_id, l.digest as leaf, l.changed, s.subroot, r.digest as root,
        list_concat(coalesce(p.path, []), coalesce(t.path, [])) as path
    from leaves l join subroots s on s.lang_tree = l.tree
    left join paths p on p.tree = l.tree and p.pos = l.pos
    left join top_paths t on t.pos = s.pos
    cross join (select digest from top_levels where n = 1) r
), folded as (
    select *, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) as proof_sha256,
        list_reduce(list_concat([coalesce(changed, leaf)], path), lambda x, s: sha256(
            case when s = '' then x when s[1] = 'L' then s[2:] || x else x || s[2:] end)) as folded_root
    from proofs
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
"""


@query
def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOW = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW.format(t='text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op13_decontaminate"] = f"""
with items as (
    select item_id, {_WORDS} as w from benchmark where text is not null
), item_windows as (
    select distinct item_id, least(10, len(w)) as size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') as passage
    from items, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(k) where len(w) > 0
), docs as (
    select row_number() over () as row_id, doc_id, {_WORDS} as w from (select doc_id, coalesce(text, '') as text from documents)
), doc_windows as (
    select row_id, k, s.size, array_to_string(w[k : k + s.size - 1], ' ') as passage
    from docs, (select distinct size from item_windows) s, unnest(range(1, len(w) - s.size + 2)) u(k)
), hits as (
    select d.row_id, d.k, d.size, i.item_id from doc_windows d join item_windows i using (size, passage)
), covered as (
    select row_id, count(distinct p) as n_hit from hits, unnest(range(k, k + size)) u(p) group by row_id
), named as (
    select row_id, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct row_id, cast(item_id as varchar) as item from hits where item_id is not null) group by row_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (row_id) left join named using (row_id)
"""
