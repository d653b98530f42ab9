"""Registered queries: operators bound to the tables, each with its SQL twin.

Inputs are derived from whole tables by the same expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as X
from .operators import aliases as A
from .operators import convergence as C
from .operators import journal as J
from .operators import matching as M
from .plans import build as B
from .plans import digest_tree as G
from .plans import document as Y
from .plans import summary as P
from .sources import archives as Z
from .sources import documents as D
from .sources import files as T
from .sources import journal_store as J3
from .sources import sinks as K
from .sources.tables import cut, shared_folder, spread
from .streaming import rollup as R
from .streaming import state as W

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ex(sql: str):
    return F.expr(sql)


def sql_id(*fields: str) -> str:
    """stable_id in DuckDB."""
    def one(x):
        h = f"lpad(to_hex(strlen({x})), 16, '0')"
        return f"unhex({' || '.join(f'substr({h}, {i}, 2)' for i in range(15, 0, -2))}) || encode({x})"

    return f"sha256({' || '.join(map(one, fields))})"


def joined(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays as text, so that results compare in any order."""
    for a in arrays:
        df = df.withColumn(a, F.array_join(F.col(a).cast("array<string>"), ","))
    return df


# documents as media
def media(spark, d):
    return t(spark, d, "documents").select(ex("concat(source, '/', lang, '/', doc_id, '.jpg')").alias("path"), F.octet_length("text").cast("long").alias("byte_len"), F.sha2("text", 256).alias("sha256"), ex("case when source in ('src0', 'src1') then 0 else 1 end").alias("rank"), "source", "lang", "doc_id")


MEDIA = "(select source || '/' || lang || '/' || doc_id || '.jpg' as path, cast(strlen(text) as bigint) byte_len, sha256(text) sha256, case when source in ('src0', 'src1') then 0 else 1 end as rank, source, lang, doc_id from documents)"


@query("content_identity", f"select path, byte_len, sha256, {sql_id(chr(39) + 'normalized-plan-operation-v1' + chr(39), 'path', 'sha256', 'cast(byte_len as varchar)')} operation_id from {MEDIA}")
def _(s, d):
    m = media(s, d)
    return m.select("path", "byte_len", "sha256", X.stable_id(F.lit("normalized-plan-operation-v1"), F.col("path"), F.col("sha256"), F.col("byte_len").cast("string")).alias("operation_id"))


@query("content_alias_collapse", f"select byte_len, sha256, first(path order by rank, path) path, count(*) n, array_to_string(list_sort(list(path))[1:8], ',') paths from {MEDIA} group by 1, 2")
def _(s, d):
    return joined(A.collapse(media(s, d)), "paths")


@query("canonical_pick", f"select path, row_number() over (partition by byte_len, sha256 order by rank, path) = 1 is_canonical from {MEDIA}")
def _(s, d):
    return A.canonical(media(s, d)).select("path", "is_canonical")


@query("alias_metadata_conflict", f"""select sha256, case when count(distinct source) < 2 and count(distinct lang) < 2 then first(source order by rank, path) end source, case when count(distinct source) < 2 and count(distinct lang) < 2 then first(lang order by rank, path) end lang,
concat_ws(',', case when count(distinct source) > 1 then 'source' end, case when count(distinct lang) > 1 then 'lang' end) conflicts from {MEDIA} group by byte_len, sha256""")
def _(s, d):
    return joined(A.resolve_metadata(media(s, d), ["source", "lang"]), "conflicts").drop("byte_len")


@query("plan_summary", f"select count(*) assets, cast(sum(case when doc_id % 3 = 0 then 1 else 0 end) as bigint) sidecars, cast(sum(byte_len) as bigint) bytes_read from {MEDIA}")
def _(s, d):
    return P.plan_summary(media(s, d).withColumn("associations", ex("case when doc_id % 3 = 0 then 1 else 0 end")))


@query("fingerprint_tree", f"""with l as (select sha256(path) d from {MEDIA}), a as (select substr(d, 1, 4) b, sha256(string_agg(d, '' order by d)) d from l group by 1), c as (select substr(b, 1, 2) b, sha256(string_agg(d, '' order by b)) d from a group by 1) select sha256(string_agg(d, '' order by b)) fingerprint from c""")
def _(s, d):
    return P.tree_fingerprint(media(s, d), "path")


# orders as images, their lines as movies
def order_media(s, d):
    image = t(s, d, "orders").select(ex("concat('o/', o_orderkey, '.jpg')").alias("path"))
    return image.unionByName(t(s, d, "lineitem").select(ex("concat('o/', l_orderkey, '.mov')").alias("path")))


@query("live_photo_pairs", f"""with g as (select o_orderkey k from orders join (select l_orderkey, count(*) n from lineitem group by 1) on o_orderkey = l_orderkey where n = 1)
select {sql_id("'live-photo-v1'", "'o/' || k || '.jpg'", "'o/' || k || '.mov'")} pair_id, 'o/' || k || '.jpg' image, 'o/' || k || '.mov' video from g""")
def _(s, d):
    return M.live_pairs(order_media(s, d))


@query("dependency_binding", """with l as (select l_orderkey, count(*) n from lineitem group by 1), p as (select o_orderkey k from orders join l on o_orderkey = l_orderkey where n = 1)
select 'i' || k operation_id, k pair_id, 'image' as role, 'v' || k video_operation_id from p union all select 'v' || k, k, 'video', null from p""")
def _(s, d):
    one = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id")).count().where("count = 1").join(t(s, d, "orders"), ex("pair_id = o_orderkey"), "left_semi").select("pair_id")
    both = one.select(ex("explode(array('image', 'video'))").alias("role"), "pair_id").select(ex("concat(substr(role, 1, 1), pair_id)").alias("operation_id"), "pair_id", "role")
    return M.bind_pairs(both).drop("missing_video")


@query("orphan_sidecars", "select cast(o_orderkey as varchar) k from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(s, d):
    return M.without(t(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("k")), t(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("k")), "k")


@query("unmatched_media", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 40)")
def _(s, d):
    return M.without(t(s, d, "part").select("p_partkey"), t(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


# parts as media: directory by size, name from the key
def part_media(s, d):
    return t(s, d, "part").select(ex("concat('d', p_size, '/', p_partkey, case when p_partkey % 5 = 0 then '(2)' else '' end, case p_partkey % 3 when 0 then '.jpg' when 1 then '.mp4' else '.heic' end)").alias("path"))


PART = "(select 'd' || p_size || '/' || p_partkey || case when p_partkey % 5 = 0 then '(2)' else '' end || case p_partkey % 3 when 0 then '.jpg' when 1 then '.mp4' else '.heic' end as path, p_partkey, p_size, 'd' || p_size dir, p_partkey || case when p_partkey % 5 = 0 then '(2)' else '' end stem, case p_partkey % 3 when 0 then '.jpg' when 1 then '.mp4' else '.heic' end ext from part)"


@query("sidecar_exact_match", f"select path || '.json' sidecar, path media from {PART}")
def _(s, d):
    return M.exact_sidecars(part_media(s, d).select(F.concat("path", F.lit(".json")).alias("path")), part_media(s, d))


@query("sidecar_basename_match", """with m as (select 's' || s_nationkey dir, cast(s_suppkey % 7 as varchar) stem, case when s_suppkey % 2 = 0 then 'jpg' else 'mp4' end ext, s_suppkey from supplier),
p as (select dir, stem, dir || '/' || stem || '.' || ext path, ext from m), g as (select dir, stem, count(*) n, count(*) filter (ext = 'jpg') i, min(path) a, min(path) filter (ext = 'jpg') b from p group by all),
s as (select 's' || n_nationkey dir, cast(x as varchar) stem from nation, range(0, 9) r(x))
select dir || '/' || stem || '.xmp' sidecar, case when i = 1 then b when n = 1 then a end media, case when n is null then 'orphan' when i = 1 or n = 1 then 'matched' else 'ambiguous' end outcome from s left join g using (dir, stem)""")
def _(s, d):
    m = t(s, d, "supplier").select(ex("concat('s', s_nationkey, '/', s_suppkey % 7, case when s_suppkey % 2 = 0 then '.jpg' else '.mp4' end)").alias("path"))
    side = t(s, d, "nation").select("n_nationkey", ex("explode(sequence(0, 8))").alias("x")).select(ex("concat('s', n_nationkey, '/', x, '.xmp')").alias("path"))
    return M.basename_sidecars(side, m).drop("candidates")


@query("sidecar_title_match", f"""with docs as (select dir || '/x' || p_partkey || '.json' sidecar, dir, case when p_partkey % 4 = 0 then 'none.jpg' when p_partkey % 4 = 1 then 'shared.jpg' else stem || ext end name from {PART}),
m as (select dir, stem || ext as name, path from {PART} union all select distinct dir, 'shared.jpg', dir || '/shared.jpg' from {PART}), a as (select dir, name, count(*) n, min(path) p from m group by all), b as (select dir, name, count(*) n from docs group by all)
select sidecar, case when a.n = 1 and b.n = 1 then p end media, case when a.n is null then 'unmatched' when a.n = 1 and b.n = 1 then 'matched' else 'ambiguous' end outcome from docs left join a using (dir, name) left join b using (dir, name)""")
def _(s, d):
    p = part_media(s, d).withColumn("dir", X.parent(F.col("path"))).withColumn("k", ex("cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)"))
    docs = p.select(ex("concat(dir, '/x', k, '.json')").alias("path"), ex("case when k % 4 = 0 then 'none.jpg' when k % 4 = 1 then 'shared.jpg' else substring_index(path, '/', -1) end").alias("title"))
    return M.title_sidecars(docs, p.select("path").unionByName(p.select(ex("concat(dir, '/shared.jpg')").alias("path")).distinct()))


#: Media and documents of J-4: names with an index, base names of one to many characters, long endings, and names that begin alike.
TIER_MEDIA = f"(select path, dir, stem || ext as name from {PART} union all select dir || '/' || p_partkey || '-copy' || ext, dir, p_partkey || '-copy' || ext from {PART} where p_partkey % 5 = 3)"
TIER_DOCS = f"""(select dir, case p_partkey % 10 when 0 then p_partkey || ext || '.supp(2).json' when 1 then 't' || p_partkey || '.json' when 2 then stem || ext || '.json' when 3 then p_partkey || '.json' when 4 then p_partkey || ext || '.supplemental-metadata.json'
when 5 then p_partkey || ext || '(2).json' when 6 then substr(cast(p_partkey as varchar), 1, 1) || '.json' when 7 then p_partkey || '.supplemental-metadata.json' when 8 then substr(cast(p_partkey as varchar), 1, 2) || 'x.json' else 'zz' || p_partkey || '.json' end as name,
case when p_partkey % 10 in (1, 2) then stem || ext end title from {PART})"""


@query("sidecar_tiered_match", f"""with m as {TIER_MEDIA}, d as (select distinct * from {TIER_DOCS}),
x as (select *, dir || '/' || name sidecar, regexp_extract(name, '^(.*)\\(([0-9]+)\\)[.]json$', 2) i, regexp_extract(name, '^(.*)\\(([0-9]+)\\)[.]json$', 1) h from d),
y as (select *, case when contains(h, '.') and not ends_with(h, '.') and starts_with('supplemental-metadata', regexp_extract(h, '[^.]*$')) then regexp_replace(h, '[.][^.]*$', '') else h end f from x),
z as (select *, case when i <> '' then regexp_replace(f, '[.][^.]*$', '') || '(' || i || ').' || regexp_extract(f, '[^.]*$') end indexed, regexp_replace(name, '([.]supplemental-metadata)?[.]json$', '') base from y),
c as (select sidecar, case when m.name = indexed then 0 when m.name = title then 1 when m.name = base then 2 else 3 end tier, m.path from z join m on z.dir = m.dir and (m.name = indexed or m.name = title or starts_with(m.name, base)) where base <> ''),
g as (select sidecar, tier, count(*) n, min(path) path from c group by sidecar, tier qualify row_number() over (partition by sidecar order by tier) = 1)
select z.sidecar, tier, n, case when n = 1 then path end media from z left join g on z.sidecar = g.sidecar""")
def _(s, d):
    p = part_media(s, d).withColumn("dir", X.parent(F.col("path"))).withColumn("k", ex("cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)")).withColumn("name", X.filename(F.col("path"))).withColumn("ext", ex("regexp_extract(path, '([.][a-z0-9]+)$', 1)"))
    name = """case k % 10 when 0 then concat(k, ext, '.supp(2).json') when 1 then concat('t', k, '.json') when 2 then concat(name, '.json') when 3 then concat(k, '.json') when 4 then concat(k, ext, '.supplemental-metadata.json')
        when 5 then concat(k, ext, '(2).json') when 6 then concat(left(cast(k as string), 1), '.json') when 7 then concat(k, '.supplemental-metadata.json') when 8 then concat(left(cast(k as string), 2), 'x.json') else concat('zz', k, '.json') end"""
    docs = p.select(ex(f"concat(dir, '/', {name})").alias("path"), ex("case when k % 10 in (1, 2) then name end").alias("title")).distinct()
    names = p.select("path").unionByName(p.where("k % 5 = 3").select(ex("concat(dir, '/', k, '-copy', ext)").alias("path")))
    return M.tiered_sidecars(cut(docs), cut(names)).drop("candidates")  # cut: else these made-up names are inlined into every step


@query("case_collisions", "with p as (select case when p_partkey % 2 = 0 then upper(p_name) else p_name end || '/' || p_brand || '.JPG' path from part) select lower(path) folded, count(*) n, array_to_string(list_sort(list(distinct path))[1:8], ',') paths from p group by 1 having count(*) > 1")
def _(s, d):
    p = t(s, d, "part").select(ex("concat(case when p_partkey % 2 = 0 then upper(p_name) else p_name end, '/', p_brand, '.JPG')").alias("path"))
    return joined(A.case_collisions(p), "paths")


@query("duplicate_basenames", "with p as (select 'd' || p_size || '/' || p_name || '.jpg' path, 'd' || p_size dir, p_name || '.jpg' as name from part) select lower(name) as name, count(distinct dir) n_dirs, array_to_string(list_sort(list(distinct path))[1:8], ',') paths from p group by 1 having count(distinct dir) > 1")
def _(s, d):
    return joined(A.duplicate_basenames(t(s, d, "part").select(ex("concat('d', p_size, '/', p_name, '.jpg')").alias("path"))), "paths")


@query("unicode_collisions", """with p as (select nfc_normalize(case when doc_id % 2 = 0 then lang || chr(233) else lang || 'e' || chr(769) end || (doc_id // 2)) path from documents union all select lang || doc_id from documents) select path, count(*) n from p group by 1 having count(*) > 1""")
def _(s, d):
    docs = t(s, d, "documents")
    m = docs.select(ex("concat(case when doc_id % 2 = 0 then concat(lang, char(233)) else concat(lang, 'e', decode(unhex('CC81'), 'UTF-8')) end, doc_id div 2)").alias("path"))
    return A.unicode_collisions(m, docs.select(ex("concat(lang, doc_id)").alias("path")))


@query("archive_merge", "with e as (select 'p' || (doc_id // 2) path, sha256(text) sha256, strlen(text) n from documents) select path, count(*) n, case when count(distinct sha256) > 1 then 'conflict' when count(*) > 1 then 'duplicate' else 'single' end outcome from e group by 1 union all select 'same' || doc_id, 2, 'duplicate' from documents")
def _(s, d):
    docs = t(s, d, "documents")
    e = docs.select(ex("concat('p', doc_id div 2)").alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("byte_len"))
    twice = docs.select(ex("concat('same', doc_id)").alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("byte_len"))
    return A.merge_archives(e.unionByName(twice).unionByName(twice), ["sha256", "byte_len"])


@query("sidecar_conflicts", "select conv_id media, count(*) n, case when count(distinct role) = 1 then min(role) end as document from conversations group by 1")
def _(s, d):
    return A.sidecar_conflicts(t(s, d, "conversations").select(F.col("conv_id").alias("media"), F.col("role").alias("document")))


@query("rule_evidence", "select cast(user_id as varchar) path, array_to_string(list_sort(list(distinct event_type || ':' || case when value > 50 then 'hit' else 'miss' end)), ',') evidence from events group by 1")
def _(s, d):
    e = t(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("rule_id"), ex("case when value > 50 then 'hit' else 'miss' end").alias("outcome"))
    return A.evidence(e).select("path", F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["rule_id"], x["outcome"])), ",").alias("evidence"))


@query("album_membership", "select 'n' || c_nationkey || '/' || c_custkey || '.jpg' path, n_name || ',' || r_name albums from (select c_custkey, c_nationkey, least(n_name, r_name) n_name, greatest(n_name, r_name) r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)")
def _(s, d):
    m = t(s, d, "customer").select(ex("concat('n', c_nationkey, '/', c_custkey, '.jpg')").alias("path"))
    n = t(s, d, "nation").join(t(s, d, "region"), ex("n_regionkey = r_regionkey"))
    albums = n.select(ex("concat('n', n_nationkey)").alias("dir"), ex("explode(array(n_name, r_name))").alias("album"))
    return joined(M.with_albums(m, albums), "albums").select("path", "albums")


@query("album_plan_summary", "with a as (select (select count(distinct n_name) from customer join nation on c_nationkey = n_nationkey) + (select count(distinct c_mktsegment) from customer) k), o as (select count(*) operations, count(*) filter (c_acctbal > 0) metadata_updates from customer) select operations, metadata_updates, k album_creates, k album_memberships, operations + metadata_updates + 2 * k max_mutations from a, o")
def _(s, d):
    c = t(s, d, "customer").join(t(s, d, "nation"), ex("c_nationkey = n_nationkey"))
    return P.import_summary(c.select(ex("c_acctbal > 0").alias("has_metadata"), F.array("n_name", "c_mktsegment").alias("albums")))


@query("albums_by_operation", "select 'op' || c_custkey operation_id, array_to_string(list_sort(list(distinct o_orderpriority)), ',') albums, 0::bigint as unknown from orders join customer on o_custkey = c_custkey where c_acctbal > 5000 group by 1 union all select null, array_to_string(list_sort(list(distinct o_orderpriority)), ','), count(*) from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 5000)")
def _(s, d):
    members = t(s, d, "orders").select(F.col("o_orderpriority").alias("album"), F.col("o_custkey").alias("asset_id"))
    ops = t(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("asset_id"), ex("concat('op', c_custkey)").alias("operation_id"))
    return joined(C.albums_by_operation(members, ops), "albums")


@query("caption_join", "select 'n' || c_nationkey || '/' || c_custkey path, 'n' || c_nationkey dir, case when c_acctbal < 3000 then 'cap' || c_custkey else c_mktsegment end description, case when n_regionkey <> 1 then n_name end album from customer join nation on c_nationkey = n_nationkey")
def _(s, d):
    c = t(s, d, "customer")
    assets = c.select(ex("concat('n', c_nationkey, '/', c_custkey)").alias("path"), F.col("c_mktsegment").alias("description"))
    caps = c.where("c_acctbal < 3000").select(ex("concat('n', c_nationkey)").alias("dir"), F.col("c_custkey").cast("string").alias("name"), ex("concat('cap', c_custkey)").alias("caption"))
    dirs = t(s, d, "nation").where("n_regionkey <> 1").select(ex("concat('n', n_nationkey)").alias("dir"), F.col("n_name").alias("album"))
    return M.with_captions(assets, caps, dirs)


@query("xmp_binding", "with b as (select l_orderkey k, count(*) n, min('s' || l_partkey || '.xmp') x from lineitem where l_returnflag = 'R' group by 1) select 'o' || o_orderkey operation_id, case when n = 1 then x end xmp, case when n > 1 then 'unsupported' else 'bound' end outcome from orders left join b on o_orderkey = k")
def _(s, d):
    bridge = t(s, d, "lineitem").select(ex("concat('o', l_orderkey)").alias("operation_id"), ex("concat('s', l_partkey, case when l_returnflag = 'R' then '.xmp' else '.json' end)").alias("sidecar"))
    return M.bind_xmp(t(s, d, "orders").select(ex("concat('o', o_orderkey)").alias("operation_id")), bridge)


PAGE = "(select page_id, case page_id % 5 when 0 then 'a/@eaDir/' when 1 then 'a/._' when 2 then 'b/Recently Deleted/c/' else 'x/y/' end || replace(split_part(url, '://', 2), '?', '/') path from pages)"


def page_paths(s, d):
    return t(s, d, "pages").select("page_id", ex("concat(case page_id % 5 when 0 then 'a/@eaDir/' when 1 then 'a/._' when 2 then 'b/Recently Deleted/c/' else 'x/y/' end, replace(substring_index(url, '://', -1), '?', '/'))").alias("path"))


@query("noise_filter", f"select page_id, case page_id % 5 when 0 then 'a/@eaDir' when 1 then 'a/' || split_part(path, '/', 2) when 2 then 'b/Recently Deleted' end noise from {PAGE}")
def _(s, d):
    return page_paths(s, d).select("page_id", X.noise_prefix(F.col("path")).alias("noise"))


@query("album_from_path", f"select page_id, list_extract(string_split(path, '/'), -2) immediate, array_to_string(string_split(path, '/')[:-2], ' / ') joined from {PAGE}")
def _(s, d):
    return page_paths(s, d).select("page_id", X.album_from_path(F.col("path"), "immediate").alias("immediate"), X.album_from_path(F.col("path"), "joined").alias("joined"))


@query("path_rules", f"""select page_id, regexp_replace(path, '/[^/]*$', '') parent, regexp_extract(path, '[^/]*$') filename, case when contains(regexp_extract(path, '[^/]*$'), '.') then regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') else regexp_extract(path, '[^/]*$') end stem, strlen(path) > 40 too_long,
contains(path, '/../') or contains(path, '//') or starts_with(path, '/') or ends_with(path, '/') unsafe from {PAGE}""")
def _(s, d):
    p = F.col("path")
    return page_paths(s, d).select("page_id", X.parent(p).alias("parent"), X.filename(p).alias("filename"), X.stem(p).alias("stem"), X.path_too_long(p, 40).alias("too_long"), X.unsafe_entry(p).alias("unsafe"))


@query("media_kinds", "select p_partkey, case when p_partkey % 4 < 2 then 'image' when p_partkey % 4 = 2 then 'video' end kind, case when p_partkey % 4 = 3 then 'json' end meta from part")
def _(s, d):
    p = t(s, d, "part").select("p_partkey", ex("concat(p_name, case p_partkey % 4 when 0 then '.JPG' when 1 then '.heic' when 2 then '.MoV' else '.json' end)").alias("path"))
    return p.select("p_partkey", X.media_kind(F.col("path")).alias("kind"), X.metadata_kind(F.col("path")).alias("meta"))


@query("filename_date", "select event_id, case when event_id % 3 = 0 then null else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end taken from events")
def _(s, d):
    e = t(s, d, "events").select("event_id", ex("case when event_id % 3 = 0 then 'IMG_1.jpg' else concat(date_format(ts, 'yyyyMMdd-HHmmss'), '-x.jpg') end").alias("name"))
    return e.select("event_id", X.filename_date(F.col("name")).alias("taken"))


@query("epoch_to_rfc3339", "select event_id, case when event_id % 7 = 0 then null else strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') end utc, case when event_id % 7 = 0 then null else cast(floor(epoch(ts)) as bigint) * 1000 end ms from events")
def _(s, d):
    e = t(s, d, "events").select("event_id", ex("case when event_id % 7 = 0 then 'x1' else cast(unix_seconds(cast(ts as timestamp)) as string) end").alias("e"))
    return e.select("event_id", X.epoch_to_utc(F.col("e")).alias("utc")).withColumn("ms", X.rfc3339_ms(F.col("utc")))


@query("geo_normalize", """with e as (select event_id, cast(floor(value) as bigint) q, event_id % 4 m from events)
select event_id, q > 90 and m < 3 invalid, m = 3 and q <> 0 hidden, case when m < 3 and q between 1 and 90 then cast(q as varchar) end lat, case when m < 3 and q between 1 and 90 then '-' || q || case m when 0 then '.5' when 1 then '.25' else '' end end lon from e""")
def _(s, d):
    g = ex("named_struct('latitude', cast(floor(value) as double), 'longitude', -(cast(floor(value) as double) + case when floor(value) = 0 then 0D else case event_id % 4 when 0 then 0.5D when 1 then 0.25D else 0D end end))")
    e = t(s, d, "events").withColumn("exif", F.when(ex("event_id % 4 = 3"), ex("named_struct('latitude', 0D, 'longitude', 0D)")).when(ex("event_id % 4 = 1"), g)).withColumn("geo", g)
    at = X.location(F.col("exif"), F.col("geo"))
    return e.select("event_id", X.geo_invalid(F.col("exif"), F.col("geo")).alias("invalid"), X.hides_location(F.col("exif"), F.col("geo")).alias("hidden"), at["latitude"].alias("lat"), at["longitude"].alias("lon"))


@query("canonical_decimals", "select l_orderkey, l_linenumber, l_partkey, l_quantity, case when l_discount = 0 then '0' else regexp_replace(cast(cast(l_discount as decimal(10, 6)) as varchar), '0+$', '') end discount, cast(cast(l_quantity as bigint) as varchar) quantity, '-' || regexp_replace(regexp_replace(cast(cast(l_extendedprice as decimal(18, 2)) as varchar), '0+$', ''), '[.]$', '') price from lineitem")
def _(s, d):
    dec = X.canonical_decimal
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", dec(F.round("l_discount", 6)).alias("discount"), dec(F.col("l_quantity")).alias("quantity"), dec(-F.round("l_extendedprice", 2)).alias("price"))


@query("capture_times", "select event_id, case when event_id % 5 = 0 then 'p' || event_id when event_id % 5 in (1, 2) then 'c' || event_id end taken, case when event_id % 3 = 0 then null else 'd' || event_id end description from events")
def _(s, d):
    e = t(s, d, "events").select("event_id", ex("case when event_id % 5 = 0 then concat('p', event_id) end").alias("taken"), ex("case when event_id % 5 in (0, 1, 2) then concat('c', event_id) end").alias("created"), ex("case when event_id % 3 = 0 then '' else concat('d', event_id) end").alias("text"))
    return e.select("event_id", X.capture_time(F.col("taken"), F.col("created")).alias("taken"), X.description(F.col("text")).alias("description"))


@query("takeout_paths", """with p as (select p_partkey k, case p_partkey % 6 when 0 then 'Photos from 2024' when 1 then 'Photos from 24' when 2 then 'Archive' when 3 then 'Trip' when 4 then 'Bin' else 'Photos from 20245' end dir, case when p_partkey % 4 = 0 then 'x.jpg' else 'metadata.json' end as name from part)
select k, case when k % 6 = 0 then 0 else 1 end as rank, k % 6 = 3 and k % 4 <> 0 album_document, 'assets/' || k || '/' || name target from p""")
def _(s, d):
    p = t(s, d, "part").select(F.col("p_partkey").alias("k"), ex("case p_partkey % 6 when 0 then 'Photos from 2024' when 1 then 'Photos from 24' when 2 then 'Archive' when 3 then 'Trip' when 4 then 'Bin' else 'Photos from 20245' end").alias("dir"), ex("case when p_partkey % 4 = 0 then 'x.jpg' else 'metadata.json' end").alias("name"))
    path = F.concat(F.lit("Takeout/"), "dir", F.lit("/"), "name")
    return p.select("k", X.canonical_rank(path).alias("rank"), X.is_album_document(path).alias("album_document"), X.target_path(F.col("k").cast("string"), F.col("name")).alias("target"))


@query("text_rules", "select doc_id, strlen(text) between 1 and 16384 and not regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') description_ok, strlen(text) between 1 and 4096 and not regexp_matches(text, '[\\x00-\\x1F\\x7F/\\\\]') title_ok from documents")
def _(s, d):
    return t(s, d, "documents").select("doc_id", X.text_valid(F.col("text"), 16384, True).alias("description_ok"), X.text_valid(F.col("text"), 4096).alias("title_ok"))


@query("identifier_rules", "select p_partkey, p_partkey % 3 = 0 uuid, not (p_partkey % 4 = 1 or p_partkey % 4 = 2) safe, case when p_partkey % 2 = 0 then substr(sha256(p_name), 1, 40) end sha1 from part")
def _(s, d):
    p = t(s, d, "part").withColumn("h", F.sha2("p_name", 256))
    uuid = ex("concat(substr(h,1,8),'-',substr(h,9,4),'-',case when p_partkey % 3 = 0 then '4' else '5' end,substr(h,14,3),'-a',substr(h,18,3),'-',substr(h,21,12))")
    name = ex("case p_partkey % 4 when 1 then 'con.txt' when 2 then concat(p_name, '.') else concat(p_name, '.jpg') end")
    return p.select("p_partkey", X.is_uuid4(uuid).alias("uuid"), X.safe_name(name).alias("safe"), X.sha1_hex(ex("case when p_partkey % 2 = 0 then base64(unhex(substr(h, 1, 40))) else base64(unhex(substr(h, 1, 20))) end")).alias("sha1"))


@query("entry_admission", "select l_orderkey, l_linenumber, l_quantity, l_shipdate, case when l_linenumber = 7 then 'encrypted' when l_linenumber = 6 then 'unsupported_method' when l_extendedprice > 90000 then 'too_large' when l_extendedprice > 1000 and floor(floor(l_extendedprice) / greatest(cast(floor(l_quantity) as bigint) * 20, 1)) > 60 then 'ratio' end rejection from lineitem")
def _(s, d):
    x = t(s, d, "lineitem")
    why = X.entry_rejection(ex("case when l_extendedprice > 90000 then 90001 else cast(floor(l_extendedprice) as bigint) end"), ex("cast(floor(l_quantity) as bigint) * 20"), ex("case when l_linenumber = 6 then 12 else 8 end"), ex("case when l_linenumber = 7 then 1 else 0 end"), 90000, 60, 999)
    return x.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", why.alias("rejection"))


@query("import_times", "select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey * 1000 when o_orderkey % 2 = 0 then 0 else o_custkey end created, case when o_orderkey % 3 = 0 then o_orderkey * 1000 when o_orderkey % 2 = 0 then 0 else o_custkey + 5 end modified from orders")
def _(s, d):
    o = t(s, d, "orders").select("o_orderkey", ex("case when o_orderkey % 3 = 0 then o_orderkey * 1000 end").alias("t"), ex("o_custkey").alias("c"), ex("o_custkey + 5").alias("m"), ex("case when o_orderkey % 2 = 0 then 'takeout' else 'apple' end").alias("k"))
    c, m = X.import_times(F.col("t"), F.col("c"), F.col("m"), F.col("k"))
    return o.select("o_orderkey", c.alias("created"), m.alias("modified"))


@query("canonical_order", f"select path, byte_len from {MEDIA} order by path")
def _(s, d):
    return media(s, d).select("path", "byte_len").orderBy("path")  # O-1: bytewise, a range-partitioned sort


@query("json_sidecar_parse", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k, false as invalid from events")
def _(s, d):
    return D.parse_json(t(s, d, "events").select("event_id", "props"), "props", {"k": "bigint"}).select("event_id", "k", "invalid")


INI = "(select conv_id, turn, case when turn % 3 = 0 then '[' || role || ']' else 'key' || (turn % 2) || '=' || strlen(text) end line from conversations)"


@query("ini_sections", f"with x as (select *, case when starts_with(line, '[') then substr(line, 2, strlen(line) - 2) end s from {INI}) select conv_id as file, section, split_part(line, '=', 1) as key, count(distinct split_part(line, '=', 2)) > 1 conflict, min(split_part(line, '=', 2)) as value from (select *, last_value(s ignore nulls) over (partition by conv_id order by turn) section from x) where not starts_with(line, '[') group by 1, 2, 3")
def _(s, d):
    lines = t(s, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), ex("case when turn % 3 = 0 then concat('[', role, ']') else concat('key', turn % 2, '=', octet_length(text)) end").alias("text"))
    return D.ini_settings(lines)


# journals from events
JOURNAL = "(select event_id sequence, user_id, case event_type when 'click' then 'created' when 'view' then 'duplicate' when 'purchase' then 'failed' else 'indeterminate' end outcome, cast(event_id % 4 as int) retry_count from events)"


def journal(s, d):
    return t(s, d, "events").select(F.col("event_id").alias("sequence"), "user_id", ex("case event_type when 'click' then 'created' when 'view' then 'duplicate' when 'purchase' then 'failed' else 'indeterminate' end").alias("outcome"), ex("cast(event_id % 4 as int)").alias("retry_count"))


@query("journal_latest_state", f"select user_id, sequence, outcome, retry_count from {JOURNAL} qualify row_number() over (partition by user_id order by sequence desc) = 1")
def _(s, d):
    return J.latest(journal(s, d), "user_id")


@query("journal_completed", f"select user_id, outcome from (select * from {JOURNAL} qualify row_number() over (partition by user_id order by sequence desc) = 1) where outcome in ('created', 'duplicate')")
def _(s, d):
    return J.completed(journal(s, d), "user_id").select("user_id", "outcome")


@query("import_report", f"select count(*) filter (outcome = 'created') created, count(*) filter (outcome = 'duplicate') as duplicate, count(*) filter (outcome = 'failed') failed, count(*) filter (outcome = 'indeterminate') indeterminate, cast(sum(retry_count) as bigint) retried, count(distinct user_id) keys from {JOURNAL}")
def _(s, d):
    return J.report(journal(s, d).withColumnRenamed("user_id", "effect_key"))


@query("effect_violations", f"select sequence, case when user_id % 5 = 0 then 'key' when outcome in ('created', 'duplicate') and (sequence % 3 = 0 or sequence % 7 = 0) then 'id_missing' when outcome not in ('created', 'duplicate') and sequence % 3 <> 0 and sequence % 7 <> 0 then 'id_unexpected' end reason from {JOURNAL} where reason is not null")
def _(s, d):
    e = journal(s, d).select("sequence", "outcome", ex("case when user_id % 5 = 0 then concat('other:', sha2(cast(user_id as string), 256)) else concat('asset:', sha2(cast(user_id as string), 256)) end").alias("effect_key"), ex("case when sequence % 7 = 0 then case when sequence % 2 = 0 then '' else repeat('x', 5000) end when sequence % 3 <> 0 then 'r' end").alias("remote_id"))
    return J.effect_violations(e)


PLAN = "(select o_orderkey k, 'op' || o_orderkey operation_id, case when o_orderkey % 4 < 2 then o_orderkey // 4 end pair_id from orders)"


def order_plan(s, d):
    return t(s, d, "orders").select(ex("concat('op', o_orderkey)").alias("operation_id"), ex("case when o_orderkey % 4 < 2 then o_orderkey div 4 end").alias("pair_id"))


def done_orders(s, d):
    return t(s, d, "orders").where("o_orderstatus = 'F'").select(ex("concat('op', o_orderkey)").alias("operation_id"))


@query("pending_operations", f"with p as (select p.*, o_orderstatus = 'F' done from {PLAN} p join orders on k = o_orderkey) select operation_id, pair_id from p where not done or (pair_id is not null and pair_id in (select pair_id from p where not done and pair_id is not null))")
def _(s, d):
    return C.pending(order_plan(s, d), done_orders(s, d))


@query("dry_run_report", "select count(*) planned, count(*) filter (o_orderstatus = 'F') resumed, count(*) filter (o_orderstatus <> 'F') would_upload from orders")
def _(s, d):
    return J.dry_run(order_plan(s, d), done_orders(s, d))


@query("duplicate_check", "with i as (select sha256(p_name) sha1, min(p_partkey) asset_id from part where p_size <= 25 group by 1) select p_partkey, sha256(p_name) sha1, asset_id, case when asset_id is null then 'accept' else 'duplicate' end decision from part left join i on sha256(p_name) = i.sha1")
def _(s, d):
    p = t(s, d, "part").select("p_partkey", "p_size", F.sha2("p_name", 256).alias("sha1"))
    return C.duplicate_check(p.drop("p_size"), p.where("p_size <= 25").select("sha1", F.col("p_partkey").alias("asset_id")))


@query("foreign_journal_keys", "select distinct 'asset:' || sha256(cast(user_id as varchar)) effect_key from events where user_id not in (select c_custkey from customer where c_acctbal > 0)")
def _(s, d):
    keys = t(s, d, "events").select(ex("concat('asset:', sha2(cast(user_id as string), 256))").alias("effect_key"))
    plan = t(s, d, "customer").where("c_acctbal > 0").select(ex("sha2(cast(c_custkey as string), 256)").alias("operation_id"), F.array("c_mktsegment").alias("albums"))
    return C.foreign_keys(keys, C.allowed_keys(plan))


@query("plan_drift", "select o_orderkey, o_orderstatus, 'stored' side from orders where o_orderkey % 10 = 0 union all select o_orderkey, 'X', 'observed' from orders where o_orderkey % 10 = 0")
def _(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return C.drift(o, o.withColumn("o_orderstatus", ex("case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end")))


@query("list_detail_consistency", "select o_orderkey, case when o_orderstatus = 'P' then 'left_only' else 'differs' end reason, case when o_orderstatus = 'P' then '' else 'o_custkey' end fields from orders where o_orderstatus = 'P' or o_orderkey % 7 = 0")
def _(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    off = C.mismatches(o, o.where("o_orderstatus <> 'P'").withColumn("o_custkey", ex("case when o_orderkey % 7 = 0 then -1 else o_custkey end")), "o_orderkey", ["o_custkey", "o_orderstatus"])
    return joined(off, "fields")


@query("album_convergence", "select c_mktsegment album, case when n is null then 'create' when n = 1 then 'reuse' else 'ambiguous' end decision, case when n = 1 then id end album_id from (select distinct c_mktsegment from customer) left join (select p_brand b, count(*) n, min(p_partkey) id from part group by 1) on b = c_mktsegment union all select n_name, 'reuse', n_nationkey from nation")
def _(s, d):
    wanted = t(s, d, "customer").select(F.col("c_mktsegment").alias("album")).unionByName(t(s, d, "nation").select(F.col("n_name").alias("album")))
    server = t(s, d, "part").select(F.col("p_brand").alias("album"), F.col("p_partkey").alias("album_id")).unionByName(t(s, d, "nation").select(F.col("n_name").alias("album"), F.col("n_nationkey").cast("long").alias("album_id")))
    return C.album_decisions(wanted, server)


@query("archive_materialization", "select 'a/' || o_orderkey path, case when o_orderstatus = 'P' then 'download' when o_orderkey % 5 = 0 then 'conflict' else 'complete' end action from orders union all select 'x/' || c_custkey, 'extra' from customer")
def _(s, d):
    o = t(s, d, "orders").select("o_orderkey", ex("concat('a/', o_orderkey)").alias("path"), F.col("o_custkey").alias("byte_len"), F.col("o_orderstatus").alias("sha1"))
    return C.materialization(o, archive_listing(s, d, o))


def archive_listing(s, d, o):
    """What a destination holds: orders but for pending ones, some with another checksum, and strangers."""
    have = o.where("sha1 <> 'P'").withColumn("sha1", ex("case when o_orderkey % 5 = 0 then 'zz' else sha1 end")).drop("o_orderkey")
    extra = t(s, d, "customer").select(ex("concat('x/', c_custkey)").alias("path"), F.col("c_custkey").alias("byte_len"), F.lit("q").alias("sha1"))
    return have.unionByName(extra)


@query("archive_report", "select count(*) filter (o_orderstatus = 'P') downloaded, count(*) filter (o_orderstatus <> 'P' and o_orderkey % 5 <> 0) already_complete, count(*) filter (o_orderstatus <> 'P' and o_orderkey % 5 = 0) conflicts, cast(sum(o_custkey) filter (o_orderstatus = 'P') as bigint) bytes_written from orders")
def _(s, d):
    o = t(s, d, "orders").select("o_orderkey", ex("concat('a/', o_orderkey)").alias("path"), F.col("o_custkey").alias("byte_len"), F.col("o_orderstatus").alias("sha1"))
    return C.archive_report(o, archive_listing(s, d, o))


@query("remote_live_roles", """with i as (select o_orderkey id, case when o_orderkey % 5 = 0 then 'image' else 'video' end kind, case when o_orderkey % 5 = 0 then o_orderkey + o_custkey % 7 end link from orders), m as (select id image, link video from i where link is not null), o as (select video, count(*) n from m group by 1)
select image, m.video, case when i.kind is null then 'missing' when i.kind <> 'video' then 'not_video' when i.link is not null then 'linked' when n > 1 then 'shared' end violation from m join o using (video) left join i on m.video = i.id""")
def _(s, d):
    return C.remote_roles(t(s, d, "orders").select(F.col("o_orderkey").alias("id"), ex("case when o_orderkey % 5 = 0 then 'image' else 'video' end").alias("kind"), ex("case when o_orderkey % 5 = 0 then o_orderkey + o_custkey % 7 end").alias("linked_id")))


@query("linked_closure", "with l as (select o_orderkey id, o_custkey linked_id from orders where o_orderstatus = 'F') select * from l union all select o_orderkey, o_custkey from orders where o_orderkey in (select linked_id from l) and o_orderkey not in (select id from l)")
def _(s, d):
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("linked_id"), "o_orderstatus")
    return C.linked_closure(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.drop("o_orderstatus"))


@query("visibility_union", "with x as (select l_orderkey id, l_returnflag f, l_linestatus s from lineitem) select id, count(*) n, count(distinct f || s) > 1 as conflict, case when count(distinct f || s) = 1 then min(f) end f, case when count(distinct f || s) = 1 then min(s) end s from x group by 1")
def _(s, d):
    x = t(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))
    return C.visibility_union(*[x.where(F.col("f") == f) for f in ("A", "N", "R")], fields=["f", "s"])


@query("in_scope_members", "select distinct o_custkey asset_id, o_orderpriority album from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def _(s, d):
    return C.in_scope(t(s, d, "orders").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderpriority").alias("album")), t(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("asset_id")))


@query("byte_multiset_difference", "with a as (select sha256(text) h, count(*) n from documents where lang = 'en' group by 1), b as (select sha256(text) h, count(*) n from documents where source <> 'src0' group by 1) select h sha256, coalesce(a.n, 0) n_a, coalesce(b.n, 0) n_b from a full join b using (h) where coalesce(a.n, 0) <> coalesce(b.n, 0)")
def _(s, d):
    m = media(s, d)
    return C.multiset_difference(m.where("lang = 'en'"), m.where("source <> 'src0'"), ["sha256"])


@query("differential_facts", "with a as (select distinct p_name path from part where p_size < 40), b as (select distinct p_name path from part), n as (select count(*) filter (b.path is null) x, count(*) filter (a.path is null) y, count(*) e from a full join b on a.path = b.path) select 'equal' check_id, x + y = 0 passed from n union all select 'subset', x = 0 from n union all select 'superset', y = 0 from n union all select 'disjoint', x + y = e from n")
def _(s, d):
    p = t(s, d, "part").select(F.col("p_name").alias("path"), "p_size")
    return C.differential(p.where("p_size < 40"), p)


@query("operation_order", """with o as (select conv_id || '-' || turn operation_id, 'p' || conv_id || '/' || turn path, case when turn < 2 then conv_id end pair_id, turn = 1 is_video from conversations)
select operation_id, path, pair_id, is_video, first_value(path) over w leader, row_number() over w nth from o window w as (partition by coalesce(cast(pair_id as varchar), operation_id) order by is_video desc, path)""")
def _(s, d):
    c = t(s, d, "conversations").select(ex("concat(conv_id, '-', turn)").alias("operation_id"), ex("concat('p', conv_id, '/', turn)").alias("path"), ex("case when turn < 2 then conv_id end").alias("pair_id"), ex("turn = 1").alias("is_video"))
    return J.dependency_order(c.withColumn("key", F.col("pair_id")).withColumn("pair_id", F.col("pair_id").cast("string"))).withColumn("pair_id", F.col("key")).drop("key")


@query("history_retention", "select event_id sequence, user_id from events where value >= 100 order by event_id desc limit 50")
def _(s, d):
    return J.retain(t(s, d, "events").select(F.col("event_id").alias("sequence"), "user_id", F.col("value").alias("recorded_unix")), 100, 50).select("sequence", "user_id")


@query("page_contiguity", "with p as (select conv_id listing, turn page, strlen(role) items, 4 declared from conversations where turn <> 2) select listing, page, lead(page) over (partition by listing order by page) <> page + 1 gap, items <> declared count_off from p qualify coalesce(gap, false) or count_off")
def _(s, d):
    return J.page_gaps(t(s, d, "conversations").where("turn <> 2").select(F.col("conv_id").alias("listing"), F.col("turn").alias("page"), F.octet_length("role").alias("items"), F.lit(4).alias("declared")))


@query("strict_order", "select conv_id, turn from (select *, lag(strlen(text)) over (partition by conv_id order by turn) p from conversations) where p >= strlen(text)")
def _(s, d):
    return J.order_violations(t(s, d, "conversations").withColumn("v", F.octet_length("text")), "conv_id", "turn", "v")


@query("cursor_replay", "with g as (select user_id run, min(event_id) low, max(event_id) high from events group by 1), c as (select c_custkey run, c_custkey * 70 - 40 as cursor from customer) select run, cursor, case when cursor > high then 'invalid' when cursor + 1 < low then 'exhausted' else 'ok' end status, case when cursor > high or cursor + 1 < low then 0 else (select count(*) from events where user_id = run and event_id > cursor) end n from g join c using (run)")
def _(s, d):
    return J.replay(t(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("sequence")), t(s, d, "customer").select(F.col("c_custkey").alias("run"), ex("c_custkey * 70 - 40").alias("cursor")))


@query("replay_buffer", "select user_id run, event_id sequence from events qualify row_number() over (partition by user_id order by event_id desc) <= 8")
def _(s, d):
    return J.newest(t(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("sequence")), 8)


@query("benchmark_stats", "select event_type, min(value) lowest, median(value) median, quantile_disc(value, 0.95) p95, max(value) highest from events group by 1")
def _(s, d):
    return J.statistics(t(s, d, "events"), "event_type")


@query("status_gauges", f"select outcome, count(*) n from {JOURNAL} group by 1")
def _(s, d):
    return J.gauges(journal(s, d), "outcome")


@query("receipt_freshness", "select c_custkey receipt_ref, c_nationkey plan_ref, c_custkey % 3 plan_digest, c_mktsegment config from customer join nation on n_nationkey = c_nationkey where c_custkey % 3 = n_regionkey % 3")
def _(s, d):
    r = t(s, d, "customer").select(F.col("c_custkey").alias("receipt_ref"), F.col("c_nationkey").alias("plan_ref"), ex("c_custkey % 3").alias("plan_digest"), F.col("c_mktsegment").alias("config"))
    return J.fresh_receipts(r, t(s, d, "nation").select(F.col("n_nationkey").alias("plan_ref"), ex("cast(n_regionkey % 3 as bigint)").alias("plan_digest")), ["plan_digest"])


@query("limit_violations", "with f as (select source dir, cast(strlen(text) as bigint) b from documents), g as (select dir, count(*) n, max(b) m, sum(b) s from f group by 1) select 'directory' \"limit\", dir as key, n as value from g where n > 40 union all select 'asset_bytes', dir, m from g where m > 9000 union all select 'entries', '', cast(sum(n) as bigint) from g having sum(n) > 500 union all select 'total_bytes', '', cast(sum(s) as bigint) from g having sum(s) > 1000000")
def _(s, d):
    return P.limit_violations(media(s, d).select(F.col("source").alias("dir"), "byte_len"), 500, 40, 9000, 1_000_000)


@query("upload_summary", "select count(*) operations, cast(sum(o_custkey) as bigint) media_bytes, count(*) filter (o_orderkey % 3 = 0) xmp, count(distinct case when o_orderkey % 4 < 2 then o_orderkey // 4 end) pairs from orders")
def _(s, d):
    return P.upload_summary(order_plan(s, d).withColumn("k", ex("cast(substr(operation_id, 3) as bigint)")).join(t(s, d, "orders"), ex("k = o_orderkey")).select("pair_id", F.col("o_custkey").alias("byte_len"), ex("case when k % 3 = 0 then 'x.xmp' end").alias("xmp")))


@query("plan_violations", """with a as (select case when p_partkey % 11 = 0 then '/' || p_partkey when p_partkey % 13 = 0 then 'same' else 'p' || p_partkey end path, 'op' || (p_partkey - case when p_partkey % 17 = 0 then 1 else 0 end) op, case when p_partkey % 19 = 0 then 'bad' else sha256(p_name) end h from part)
select 'path_unique' check_id, path as key from a group by path having count(*) > 1 union all select 'operation_unique', op from a group by op having count(*) > 1 union all select 'sha256', path from a where h = 'bad' union all select 'row', path from a where starts_with(path, '/')""")
def _(s, d):
    p = t(s, d, "part").select(ex("case when p_partkey % 11 = 0 then concat('/', p_partkey) when p_partkey % 13 = 0 then 'same' else concat('p', p_partkey) end").alias("path"), ex("concat('op', p_partkey - case when p_partkey % 17 = 0 then 1 else 0 end)").alias("operation_id"), ex("case when p_partkey % 19 = 0 then 'bad' else sha2(p_name, 256) end").alias("sha256"), F.lit(1).alias("byte_len"))
    return P.plan_violations(p)


@query("upload_plan_violations", """with o as (select 'op' || o_orderkey id, case when o_orderkey % 5 < 3 then o_orderkey // 5 end pair, case when o_orderkey % 5 = 0 then 'image' when o_orderkey % 5 in (1, 3) then 'video' end as role from orders)
select 'pair' check_id, cast(pair as varchar) as key from o where pair is not null group by pair having count(*) filter (role = 'image') <> 1 or count(*) filter (role = 'video') <> 1 union all select 'role', id from o where (pair is null) <> (role is null)""")
def _(s, d):
    return P.upload_violations(t(s, d, "orders").select(ex("concat('op', o_orderkey)").alias("operation_id"), ex("case when o_orderkey % 5 < 3 then o_orderkey div 5 end").alias("pair_id"), ex("case when o_orderkey % 5 = 0 then 'image' when o_orderkey % 5 in (1, 3) then 'video' end").alias("role")))


@query("metadata_violations", "select 'albums' check_id, cast(p_partkey as varchar) as key from part where p_brand >= p_type union all select 'taken_at', cast(p_partkey as varchar) from part where p_partkey % 6 = 0")
def _(s, d):
    p = t(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.array("p_brand", "p_type").alias("albums"), ex("case when p_partkey % 6 = 0 then '2024-01-01T00:00:00.500Z' else '2024-01-01T00:00:00Z' end").alias("taken_at"))
    return P.metadata_violations(p)


@query("archive_violations", """with h as (select o_orderkey k, sha256(cast(o_orderkey - case when o_orderkey % 17 = 0 then 1 else 0 end as varchar)) h, case when o_orderkey % 13 = 0 then 'con.txt' else o_orderkey || '.jpg' end as name from orders),
i as (select *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || case when k % 11 = 0 then '5' else '4' end || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) id from h), a as (select *, case when k % 19 = 0 then 'other/' else 'assets/' end || id || '/' || name path from i)
select 'asset' check_id, id as key from a where k % 11 = 0 or k % 13 = 0 or k % 19 = 0 union all select 'asset_unique', id from a group by id having count(*) > 1 union all select 'path_unique', path from a group by path having count(*) > 1""")
def _(s, d):
    h = t(s, d, "orders").select(F.col("o_orderkey").alias("k"), ex("sha2(cast(o_orderkey - case when o_orderkey % 17 = 0 then 1 else 0 end as string), 256)").alias("h"), F.col("o_custkey").alias("byte_len"), ex("case when o_orderkey % 13 = 0 then 'con.txt' else concat(o_orderkey, '.jpg') end").alias("original_file_name"))
    a = h.withColumn("asset_id", ex("concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', case when k % 11 = 0 then '5' else '4' end, substr(h, 14, 3), '-a', substr(h, 18, 3), '-', substr(h, 21, 12))"))
    return P.archive_violations(a.withColumn("checksum_sha1", ex("substr(h, 1, 40)")).withColumn("target_path", ex("concat(case when k % 19 = 0 then 'other/' else 'assets/' end, asset_id, '/', original_file_name)")))


@query("progress_stream", "select user_id run, max(event_id) sequence, arg_max(event_type, event_id) stage, max(cast(floor(value) as bigint)) assets_observed, max(cast(strlen(props) as bigint)) bytes_read from events group by 1")
def _(s, d):
    e = R.event_stream(s, d, "events", EVENTS)
    p = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("sequence"), F.col("event_type").alias("stage"), F.floor("value").alias("assets_observed"), F.octet_length("props").cast("long").alias("bytes_read"))
    return R.drain(R.progress(p), ["run"])


@query("journal_stream", f"select user_id effect_key, sequence, outcome from {JOURNAL} qualify row_number() over (partition by user_id order by sequence desc) = 1")
def _(s, d):
    e = R.event_stream(s, d, "events", EVENTS)
    j = e.select(F.col("user_id").alias("effect_key"), F.col("event_id").alias("sequence"), ex("case event_type when 'click' then 'created' when 'view' then 'duplicate' when 'purchase' then 'failed' else 'indeterminate' end").alias("outcome"))
    return R.drain(W.journal_fold(j), ["effect_key"])


@query("terminal_runs", "select user_id run, arg_min(event_type, event_id) stage, min(event_id) sequence from events where event_type in ('purchase', 'logout') group by 1")
def _(s, d):
    e = R.event_stream(s, d, "events", EVENTS)
    p = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("sequence"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"))
    return R.deliveries(W.terminal_runs(p, ("purchase", "logout"), "event", 3_600_000)).drop("_batch")


@query("replay_buffer_stream", "select run, string_agg(sequence, ',' order by sequence) sequences from (select user_id run, event_id sequence from events qualify row_number() over (partition by user_id order by event_id desc) <= 8) group by 1")
def _(s, d):
    e = R.event_stream(s, d, "events", EVENTS)
    p = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("ts"))
    return joined(R.drain(W.replay_buffer(p, 8, "event", 3_600_000), ["run"]), "sequences")


@query("subscriptions", """with f as (select user_id run, min(event_id) ends from events where event_type = 'logout' group by 1), e as (select user_id run, event_id sequence, event_type stage from events left join f on run = user_id where event_id <= coalesce(ends, event_id) qualify row_number() over (partition by user_id order by event_id desc) <= 128),
g as (select run, min(sequence) low, max(sequence) high from e group by 1), c as (select c_custkey run, c_custkey // 3 subscriber, case when c_custkey % 5 > 0 then c_custkey * 70 - 40 end as after from customer), s as (select run, subscriber, after, case when low is null then 'unknown' when after > high then 'invalid' when after + 1 < low then 'exhausted' else 'event' end delivery from c left join g using (run))
select run, cast(subscriber as varchar) subscriber, delivery, null::bigint sequence, null stage from s where delivery <> 'event' union all select run, cast(subscriber as varchar), delivery, sequence, stage from s join e using (run) where delivery = 'event' and sequence > coalesce(after, -1)""")
def _(s, d):
    e = R.event_stream(s, d, "events", EVENTS).select(F.col("user_id").alias("run"), F.col("event_id").alias("sequence"), F.col("event_type").alias("stage"))
    c = R.event_stream(s, d, "customer", "c_custkey bigint").select(F.col("c_custkey").alias("run"), ex("c_custkey div 3").alias("subscriber"), ex("case when c_custkey % 5 > 0 then c_custkey * 70 - 40 end").alias("after"))
    return R.deliveries(W.subscriptions(e, c, 128, ("logout",))).drop("_batch")


@query("replayed_events", "with g as (select user_id run, min(event_id) low, max(event_id) high from events group by 1) select e.user_id run, e.event_id sequence from events e join customer on c_custkey = e.user_id join g on run = e.user_id where e.event_id > c_custkey * 70 - 40 and c_custkey * 70 - 40 <= high and c_custkey * 70 - 39 >= low")
def _(s, d):
    return J.replayed(t(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("sequence")), t(s, d, "customer").select(F.col("c_custkey").alias("run"), ex("c_custkey * 70 - 40").alias("cursor")))


@query("import_effects", """with e as (select *, case when event_type = 'purchase' then 'failed' when event_type = 'logout' then 'indeterminate' when m = 0 then case when event_type = 'click' then 'created' else 'duplicate' end when m = 2 then case when event_type = 'click' then 'created' else 'reused' end else 'completed' end outcome from (select event_id, event_id % 4 m, user_id, event_type from events))
select count(*) filter (m = 0 and outcome = 'created') created, count(*) filter (m = 0 and outcome = 'duplicate') as duplicate, count(*) filter (m = 1 and outcome = 'completed') metadata_updated, count(*) filter (m = 2 and outcome = 'created') albums_created, count(*) filter (m = 2 and outcome = 'reused') albums_reused,
count(*) filter (m = 3 and outcome = 'completed') album_memberships_updated, cast(sum(user_id % 3) as bigint) retried, count(*) filter (outcome = 'failed') failed, count(*) filter (outcome = 'indeterminate') as indeterminate, (select count(distinct c_mktsegment) from customer) resumed_effects from e""")
def _(s, d):
    e = t(s, d, "events").withColumn("m", ex("event_id % 4"))
    kind, outcome = ex("case m when 0 then 'asset' when 1 then 'metadata' when 2 then 'album' else 'membership' end"), ex("case when event_type = 'purchase' then 'failed' when event_type = 'logout' then 'indeterminate' when m = 0 then case when event_type = 'click' then 'created' else 'duplicate' end when m = 2 then case when event_type = 'click' then 'created' else 'reused' end else 'completed' end")
    effects = e.select(F.concat_ws(":", kind, F.sha2(F.col("event_id").cast("string"), 256)).alias("effect_key"), outcome.alias("outcome"), ex("cast(user_id % 3 as int)").alias("retry_count"))
    return J.import_report(effects, t(s, d, "customer").select(F.col("c_mktsegment").alias("effect_key")))


@query("album_members", "select o_orderpriority album, array_to_string(list_sort(list(distinct o_custkey)), ',') members from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0) group by 1")
def _(s, d):
    o = t(s, d, "orders").select(ex("concat('op', o_orderkey)").alias("operation_id"), F.array("o_orderpriority").alias("albums"), "o_custkey")
    ids = o.join(t(s, d, "customer").where("c_acctbal > 0"), ex("o_custkey = c_custkey"), "left_semi").select("operation_id", F.col("o_custkey").alias("asset_id"))
    return joined(P.album_members(o.drop("o_custkey"), ids), "members")


@query("migration_summary", "select count(*) assets, cast(sum(c_custkey) as bigint) media_bytes, count(*) filter (c_acctbal > 0) metadata_updates, (select count(*) from nation) album_creates, (select count(*) from nation) album_memberships, count(*) + count(*) filter (c_acctbal > 0) + 2 * (select count(*) from nation) max_mutations from customer")
def _(s, d):
    return P.migration_summary(t(s, d, "customer").select(F.col("c_custkey").alias("byte_len"), ex("c_acctbal > 0").alias("has_metadata")), t(s, d, "nation"))


@query("archive_summary", "select count(*) assets, cast(sum(strlen(text)) as bigint) media_bytes from documents")
def _(s, d):
    return P.archive_summary(media(s, d))


@query("bounded_inventory", "select o_orderkey id, (row_number() over (order by o_orderkey) - 1) // 1000 + 1 page from orders")
def _(s, d):
    return P.bounded_inventory(t(s, d, "orders").select(F.col("o_orderkey").alias("id")), 1000, 10**12)


@query("plan_limits", "with m as (select o_orderpriority album, count(*) n from orders group by 1) select 'assets' as limit, '' as key, (select count(*) from customer) as value union all select 'albums', '', (select count(*) from m) union all select 'memberships', '', (select cast(sum(n) as bigint) from m) union all select 'album_members', album, n from m where n > 100")
def _(s, d):
    return P.plan_limit_violations(t(s, d, "customer"), t(s, d, "orders").select(F.col("o_orderpriority").alias("album"), F.col("o_custkey").alias("asset_id")), 1, 1, 1, 100)


@query("dependency_violations", "select 'dependency' check_id, 'i' || o_orderkey as key from orders where o_orderkey % 3 = 0 or o_orderkey % 7 = 0")
def _(s, d):
    o = t(s, d, "orders").select("o_orderkey")
    image = o.select(ex("concat('i', o_orderkey)").alias("operation_id"), F.col("o_orderkey").alias("pair_id"), F.lit("image").alias("role"), ex("case when o_orderkey % 3 <> 0 then concat('v', o_orderkey) end").alias("video_operation_id"))
    video = o.select(ex("concat('v', o_orderkey)").alias("operation_id"), ex("case when o_orderkey % 7 = 0 then -1 else o_orderkey end").alias("pair_id"), F.lit("video").alias("role"), F.lit(None).cast("string").alias("video_operation_id"))
    return P.dependency_violations(image.unionByName(video))


@query("migration_violations", """with a as (select o_orderkey k, sha256(cast(o_orderkey as varchar)) h from orders), i as (select k, h, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || case when k % 11 = 0 then '5' else '4' end || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) id from a)
select 'asset' check_id, id as key from i where k % 11 = 0 or k % 13 = 0 or k % 17 = 0 union all select 'album', n_name from nation where n_nationkey % 4 = 0 union all select 'album_member', n_name from nation where n_nationkey % 5 = 0""")
def _(s, d):
    a = t(s, d, "orders").select(F.col("o_orderkey").alias("k"), ex("sha2(cast(o_orderkey as string), 256)").alias("h"))
    none = F.lit(None).cast("string")
    assets = a.select(ex("concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', case when k % 11 = 0 then '5' else '4' end, substr(h, 14, 3), '-a', substr(h, 18, 3), '-', substr(h, 21, 12))").alias("source_asset_id"), F.col("h").alias("operation_id"), ex("case when k % 13 = 0 then 'nul.jpg' else concat(k, '.jpg') end").alias("original_file_name"), F.lit(1).alias("byte_len"), ex("substr(h, 1, 40)").alias("checksum_sha1"), F.col("h").alias("content_sha256"), ex("case when k % 17 = 0 then null else 0L end").alias("created_ms"), F.lit(0).cast("long").alias("modified_ms"), none.alias("pair_id"), none.alias("role"), none.alias("video_operation_id"), F.lit(False).alias("has_metadata"))
    first = t(s, d, "orders").agg(F.min("o_orderkey").alias("k")).select(ex("sha2(cast(k as string), 256)").alias("one"))
    albums = t(s, d, "nation").crossJoin(F.broadcast(first)).select(F.col("n_name").alias("name"), ex("case when n_nationkey % 20 = 0 then array('zz', 'a') when n_nationkey % 4 = 0 then array(one, one) when n_nationkey % 5 = 0 then array('0', one) else array(one) end").alias("member_operation_ids"))
    return P.migration_violations(assets, albums)


# whole plans: parts as media of an export, with documents made of their columns
def export(s, d):
    """media and sidecars: parts by directory and name, every third with a JSON document, a few of them broken."""
    p = spread(t(s, d, "part"), "p_partkey").withColumn("dir", ex("concat('Takeout/Google Photos/', case when p_size % 3 = 0 then 'Photos from 2024' else concat('Trip ', p_size) end)")).withColumn("name", ex("concat(p_partkey, case p_partkey % 3 when 0 then '.jpg' when 1 then '.mov' else '.heic' end)"))
    content = ex("concat('content', p_partkey div 4)")
    m = p.select(ex("concat(dir, '/', name)").alias("path"), F.octet_length(content).cast("long").alias("byte_len"), F.sha2(content, 256).alias("sha256"))
    text = ex("""case when p_partkey % 21 = 0 then '{"title":5}' else concat('{"title":"', name, '","description":"', p_type, '","photoTakenTime":{"timestamp":"', p_partkey * 1000, '"},"geoData":{"latitude":', p_size, '.5,"longitude":-1}}') end""")
    docs = p.where("p_partkey % 3 = 0").select(ex("concat(dir, '/', name, case when p_partkey % 2 = 0 then '.json' else '.supplemental-metadata.json' end)").alias("path"), text.alias("text"))
    lone = p.where("p_partkey % 50 = 1").select(ex("concat(dir, '/lone', p_partkey, '.json')").alias("path"), ex("""concat('{"title":"none', p_partkey, '.jpg"}')""").alias("text"))
    albums = p.where("p_size % 3 <> 0").select("dir", "p_size").distinct().select(ex("concat(dir, '/metadata.json')").alias("path"), ex("""concat('{"title":"Album ', p_size, '"}')""").alias("text"))
    side = docs.unionByName(lone).unionByName(albums)
    return cut(m), cut(side.select("path", F.lit("json").alias("kind"), F.octet_length("text").cast("long").alias("byte_len"), F.sha2("text", 256).alias("sha256"), "text"))


EXPORT = """p as (select *, 'Takeout/Google Photos/' || case when p_size % 3 = 0 then 'Photos from 2024' else 'Trip ' || p_size end dir, p_partkey || case p_partkey % 3 when 0 then '.jpg' when 1 then '.mov' else '.heic' end as name from part),
m as (select *, dir || '/' || name path, cast(strlen('content' || p_partkey // 4) as bigint) len, sha256('content' || p_partkey // 4) h, case when p_size % 3 = 0 then 0 else 1 end as rank, p_partkey % 3 = 0 and p_partkey % 21 <> 0 doc, p_size % 3 <> 0 album from p),
g as (select len, h, first(path order by rank, path) path, count(*) n, count(distinct case when doc then p_type end) d1, count(distinct case when doc then p_partkey end) d2, count(distinct case when doc then p_size end) d3, bool_or(doc or album) any_meta,
  first(p_type order by rank, path) filter (doc) description, first(p_partkey order by rank, path) filter (doc) taken, first(p_size order by rank, path) filter (doc) lat, count(*) filter (doc) docs, count(distinct p_size) filter (album) album_files, array_to_string(list_sort(list(distinct 'Album ' || p_size) filter (album)), ',') albums, list_sort(list(path))[1:8] paths from m group by 1, 2)"""


@query("takeout_plan_assets", f"""with {EXPORT} select path relative_path, len byte_len, h content_sha256, {sql_id("'normalized-plan-operation-v1'", "path", "h", "cast(len as varchar)")} operation_id, docs + album_files associations,
any_meta and d1 < 2 and d2 < 2 and d3 < 2 has_metadata, case when d1 < 2 and d2 < 2 and d3 < 2 then description end description, case when d1 < 2 and d2 < 2 and d3 < 2 and taken is not null then strftime(make_timestamp(taken * 1000000000), '%Y-%m-%dT%H:%M:%SZ') end taken_at_utc,
case when d1 < 2 and d2 < 2 and d3 < 2 then lat || '.5' end latitude, case when any_meta and d1 < 2 and d2 < 2 and d3 < 2 then coalesce(albums, '') end albums, 1 + cast(docs > 0 as int) + cast(album_files > 0 as int) + cast(n > 1 as int) proofs from g""")
def _(s, d):
    plan = B.build_plan("google_takeout", *export(s, d))
    n = F.col("normalized_metadata")
    return plan.assets.select("relative_path", "byte_len", "content_sha256", "operation_id", F.size("metadata").cast("long").alias("associations"), n.isNotNull().alias("has_metadata"), n["description"].alias("description"), n["taken_at_utc"].alias("taken_at_utc"), n["location"]["latitude"].alias("latitude"), F.when(n.isNotNull(), F.array_join(n["albums"], ",")).alias("albums"), F.size("evidence").alias("proofs"))


@query("takeout_plan_findings", f"""with {EXPORT}, side as (select dir || '/' || name || case when p_partkey % 2 = 0 then '.json' else '.supplemental-metadata.json' end path, p_partkey from m where p_partkey % 3 = 0),
f as (select 'invalid_takeout_json' code, path from side where p_partkey % 21 = 0 union all select 'takeout_metadata_without_media', dir || '/lone' || p_partkey || '.json' from m where p_partkey % 50 = 1
union all select 'content_identical_takeout_aliases', array_to_string(paths, ',') from g where n > 1 union all select 'conflicting_takeout_description', path from g where d1 > 1 union all select 'conflicting_takeout_timestamp', path from g where d2 > 1 union all select 'conflicting_takeout_location', path from g where d3 > 1
union all select 'takeout_media_without_json', path from g where docs = 0) select code, path paths from f""")
def _(s, d):
    return joined(B.build_plan("google_takeout", *export(s, d)).findings.select("code", "paths"), "paths")


@query("takeout_plan_summary", f"""with {EXPORT} select count(*) assets, cast(sum(docs + album_files) as bigint) sidecars, (select cast(sum(len) as bigint) from m)
+ (select cast(sum(case when p_partkey % 21 = 0 then 11 else strlen('{{"title":"' || name || '","description":"' || p_type || '","photoTakenTime":{{"timestamp":"' || p_partkey * 1000 || '"}},"geoData":{{"latitude":' || p_size || '.5,"longitude":-1}}}}') end) as bigint) from m where p_partkey % 3 = 0)
+ (select cast(coalesce(sum(strlen('{{"title":"none' || p_partkey || '.jpg"}}')), 0) as bigint) from m where p_partkey % 50 = 1) + (select cast(sum(strlen('{{"title":"Album ' || p_size || '"}}')) as bigint) from (select distinct p_size from m where album)) bytes_read from g""")
def _(s, d):
    return B.build_plan("google_takeout", *export(s, d)).summary


@query("folder_plan_findings", f"""with {PART.replace('(select', 'q as (select', 1)}, m as (select path, dir, stem, ext from q), side as (select case when p_partkey % 4 = 0 then path || '.json' when p_partkey % 4 = 1 then dir || '/' || stem || '.xmp' else dir || '/no' || p_partkey || '.xmp' end path, p_partkey % 4 c from q)
select 'sidecar_without_media' code, path paths from side where c > 1""")
def _(s, d):
    p = part_media(s, d).withColumn("k", ex("cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)"))
    side = p.select(ex("case when k % 4 = 0 then concat(path, '.json') when k % 4 = 1 then concat(regexp_replace(path, '[.][a-z0-9]+$', ''), '.xmp') else concat(regexp_replace(path, '/.*', ''), '/no', k, '.xmp') end").alias("path"))
    side = side.select("path", X.metadata_kind(F.col("path")).alias("kind"), F.lit(1).cast("long").alias("byte_len"), F.lit("").alias("text"))
    m = p.select("path", F.lit(1).cast("long").alias("byte_len"), F.sha2("path", 256).alias("sha256"))
    return joined(B.build_plan("folder", cut(m), cut(side)).findings.select("code", "paths"), "paths")


@query("ini_documents", """with l as (select conv_id f, 'd' || conv_id dir, turn, case when turn = 0 then '[Picasa]' when turn = 1 then 'name=' || role when turn % 2 = 0 then '[' || role || turn || '.jpg]' else case when conv_id % 7 = 0 and turn = 3 then 'broken' else 'caption=c' || strlen(text) end end line from conversations),
bad as (select distinct f from l where line = 'broken'), c as (select l.dir, lag(line) over (partition by f order by turn) s, line, f, turn from l)
select dir, trim(s, '[]') as name, substr(line, 9) caption from c where starts_with(line, 'caption=') and starts_with(s, '[') and f not in (select f from bad)""")
def _(s, d):
    c = t(s, d, "conversations").withColumn("line", ex("case when turn = 0 then '[Picasa]' when turn = 1 then concat('name=', role) when turn % 2 = 0 then concat('[', role, turn, '.jpg]') else case when conv_id % 7 = 0 and turn = 3 then 'broken' else concat('caption=c', octet_length(text)) end end"))
    files = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("x")).select(ex("concat('d', conv_id, '/.picasa.ini')").alias("path"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))
    return D.read_ini(files)[1]


def search_pages(s, d):
    """Customers as exported search pages of 20, a directory a nation, a page a line."""
    c = t(s, d, "customer").select(F.col("c_nationkey").alias("listing"), F.col("c_custkey").alias("id"), ex("(row_number() over (partition by c_nationkey order by c_custkey) - 1) div 20 + 1").alias("page"))
    g = c.groupBy("listing", "page").agg(ex("array_sort(collect_list(named_struct('id', cast(id as string), 'originalFileName', concat(id, '.jpg'))))").alias("items"), F.count("*").alias("n"))
    g = g.withColumn("last", ex("max(page) over (partition by listing)"))
    page = ex("to_json(named_struct('assets', named_struct('items', items, 'count', n, 'nextPage', case when page < last then cast(page + 1 as string) end, 'total', n)))")
    path = shared_folder(s)
    g.select("listing", page.alias("value")).write.partitionBy("listing").text(path)
    return path + "/*"


@query("inventory_pages", "select c_nationkey nation, (r - 1) // 20 + 1 page, count(*) items, count(*) declared from (select c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) r from customer) group by 1, 2")
def _(s, d):
    pages = D.read_inventory(s, search_pages(s, d), False)[1]
    return pages.select(ex("cast(regexp_extract(listing, 'listing=([0-9]+)', 1) as bigint)").alias("nation"), "page", F.col("items").cast("long").alias("items"), "declared")


@query("album_pages", "select 'listing=' || c_nationkey album, cast(c_custkey as varchar) asset_id from customer where c_acctbal > 0")
def _(s, d):
    scope = t(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id"))
    return D.read_albums(s, search_pages(s, d), scope, False)


@query("effects_journal", "select event_id sequence, sha256(cast(user_id as varchar)) effect_key from events")
def _(s, d):
    path, e = shared_folder(s), t(s, d, "events").select(F.col("event_id").alias("sequence"), F.sha2(F.col("user_id").cast("string"), 256).alias("effect_key"))
    write = K.append_effects(path)
    write(e.where("sequence % 2 = 0"), 0)
    write(e.where("sequence % 2 = 1"), 1)
    write(e.where("sequence % 2 = 1").unionByName(e.where("sequence % 2 = 1")), 1)  # delivered again
    return K.read_effects(s, path)


@query("effects_journal_stream", "select event_id sequence, sha256(cast(user_id as varchar)) effect_key from events where event_id % 3 < 2")
def _(s, d):
    path, e = shared_folder(s), t(s, d, "events").select(F.col("event_id").alias("sequence"), F.sha2(F.col("user_id").cast("string"), 256).alias("effect_key"))
    write, at = K.append_effects(path), shared_folder(s)
    stream = lambda: K.stream_effects(s, path, "sequence bigint, effect_key string")
    write(e.where("sequence % 3 = 0"), 0)
    R.advance(stream(), at)
    J3.Journal(s, path).stage(e.where("sequence % 3 = 2"))  # never committed
    write(e.where("sequence % 3 = 1"), 1)
    write(e.where("sequence % 3 = 1"), 1)
    return R.deliveries(stream(), at).drop("_batch")


@query("history_sink", "select event_id sequence, cast(floor(epoch(ts)) as bigint) recorded_unix, event_type status from events where event_type in ('purchase', 'logout')")
def _(s, d):
    path, h = shared_folder(s), t(s, d, "events").where("event_type in ('purchase', 'logout')").select(F.col("event_id").alias("sequence"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("recorded_unix"), F.col("event_type").alias("status"))
    K.append_history(h.where("sequence % 2 = 0"), path)
    K.append_history(h.unionByName(h), path)
    return K.read_stored(s, path)


@query("receipts_sink", "select c_custkey receipt_ref, c_nationkey plan_ref, true stored from customer")
def _(s, d):
    path, r = shared_folder(s), t(s, d, "customer").select(F.col("c_custkey").alias("receipt_ref"), F.col("c_nationkey").alias("plan_ref"))
    K.append_receipts(r.where("receipt_ref % 3 = 0"), path)
    K.append_receipts(r, path)
    return K.read_stored(s, path)


@query("plan_sink", "select p_partkey path, p_size byte_len from part")
def _(s, d):
    path, p = shared_folder(s), t(s, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("byte_len"))
    K.write_plan(p, p.limit(0), P.archive_summary(p), path)
    return s.read.parquet(f"{path}/assets")


# documents as the files of an export: every kind, export noise, a name in two forms of Unicode, parts of an archive
def export_files(s, d):
    """(native, path, text) of one file a document."""
    kind = "case doc_id % 5 when 0 then '.jpg' when 1 then '.MOV' when 2 then '.json' when 3 then '.txt' else '.xmp' end"
    path = f"concat(source, '/', lang, '/', case when doc_id % 11 = 0 then '@eaDir/' else '' end, case when doc_id % 7 = 0 then 'cafe\\u0301' else 'n' end, doc_id, {kind})"
    return t(s, d, "documents").select(ex(path).cast("binary").alias("native"), F.coalesce("text", F.lit("")).cast("binary").alias("body"), "doc_id")


def write_tree(files, root):
    """Each task writes its rows; a task that runs again writes the same."""

    def run(batches):
        import os

        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))
        for batch in batches:
            for native, body in zip(batch.column(0), batch.column(1), strict=True):
                at = f"{top}/{native.as_py().decode()}"
                system.create_dir(at.rpartition("/")[0])
                with system.open_output_stream(at) as out:
                    out.write(body.as_buffer())
        yield from ()

    files.select("native", "body").mapInArrow(run, "native binary, body binary").write.format("noop").mode("overwrite").save()


def write_parts(files, root, parts):
    """ZIP parts, each streamed by one task: (part, native, body)."""

    def run(batches):
        import io
        import os
        import zipfile

        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))
        system.create_dir(top)
        out = z = None
        for batch in batches:
            for part, native, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if z is None:
                    out = io.BufferedWriter(system.open_output_stream(f"{top}/part{part}.zip").__enter__())
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(native.decode(), (2024, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
        if z is not None:
            z.close()
            out.close()
        yield from ()

    files.select("part", "native", "body").repartitionById(parts, "part").sortWithinPartitions("native").mapInArrow(run, "part int, native binary, body binary").write.format("noop").mode("overwrite").save()


FILES = """f as (select source || '/' || lang || '/' || case when doc_id % 11 = 0 then '@eaDir/' else '' end || case when doc_id % 7 = 0 then 'café' else 'n' end || doc_id || case doc_id % 5 when 0 then '.jpg' when 1 then '.MOV' when 2 then '.json' when 3 then '.txt' else '.xmp' end path, doc_id, source, lang, coalesce(text, '') body from documents)"""
KIND = "case doc_id % 5 when 0 then 'image' when 1 then 'video' when 2 then 'json' else 'xmp' end"


def scanned(scan):
    path = F.col("path")
    return scan.media.select("path", X.media_kind(path).alias("kind"), "byte_len", "sha256", "sha1").unionByName(scan.sidecars.select("path", "kind", "byte_len", "sha256", F.lit(None).cast("string").alias("sha1")))


@query("tree_scan", f"with {FILES} select path, {KIND} kind, cast(strlen(body) as bigint) byte_len, sha256(body) sha256, case when doc_id % 5 < 2 then base64(unhex(sha1(body))) end sha1 from f where doc_id % 5 <> 3 and doc_id % 11 <> 0")
def _(s, d):
    root = shared_folder(s)
    write_tree(export_files(s, d), root)
    return scanned(B.scan_source(s, root, "apple_photos"))


@query("tree_scan_findings", f"with {FILES} select 'known_apple_export_noise' code, source || '/' || lang || '/@eaDir' paths from f where doc_id % 11 = 0 group by 2")
def _(s, d):
    root = shared_folder(s)
    write_tree(export_files(s, d), root)
    return joined(B.scan_source(s, root, "apple_photos").findings.select("code", "paths"), "paths")


def export_parts(s, d, parts=8):
    """The files in parts by number; every tenth is in the next part too, every fiftieth there with another content."""
    f = export_files(s, d).withColumn("native", F.concat(F.lit("Takeout/Google Photos/").cast("binary"), "native"))
    twice = f.where("doc_id % 10 = 0").select("native", ex("case when doc_id % 50 = 0 then concat(body, cast('x' as binary)) else body end").alias("body"), ex(f"cast((doc_id + 1) % {parts} as int)").alias("part"))
    root = shared_folder(s)
    write_parts(f.select("native", "body", ex(f"cast(doc_id % {parts} as int)").alias("part")).unionByName(twice), root, parts)
    return [f"{root}/part{i}.zip" for i in range(parts)]


@query("archive_scan", f"with {FILES} select 'Takeout/Google Photos/' || path path, {KIND} kind, cast(strlen(body) as bigint) byte_len, sha256(body) sha256, case when doc_id % 5 < 2 then base64(unhex(sha1(body))) end sha1 from f where doc_id % 5 <> 3 and doc_id % 50 <> 0")
def _(s, d):
    return scanned(B.scan_source(s, export_parts(s, d), "google_takeout"))


@query("archive_scan_findings", f"with {FILES} select case when doc_id % 50 = 0 then 'conflicting_takeout_archive_entry' else 'identical_takeout_archive_entry' end code, 'Takeout/Google Photos/' || path paths from f where doc_id % 10 = 0")
def _(s, d):
    return joined(B.scan_source(s, export_parts(s, d), "google_takeout").findings.select("code", "paths"), "paths")


# plan documents
def documented(s, d):
    """A built plan, written with its source and read back."""
    media, sidecars = export(s, d)
    plan, path = B.build_plan("google_takeout", media, sidecars), shared_folder(s)
    Y.write_document(Y.with_source(plan, sidecars, "export"), path)
    plan.discard()
    return Y.read_document(s, path)


@query("plan_document_assets", ORACLE["takeout_plan_assets"])
def _(s, d):
    n = F.col("normalized_metadata")
    return documented(s, d).assets.select("relative_path", "byte_len", "content_sha256", "operation_id", F.size("metadata").cast("long").alias("associations"), n.isNotNull().alias("has_metadata"), n["description"].alias("description"), n["taken_at_utc"].alias("taken_at_utc"), n["location"]["latitude"].alias("latitude"), F.when(n.isNotNull(), F.array_join(n["albums"], ",")).alias("albums"), F.size("evidence").alias("proofs"))


@query("plan_document_findings", ORACLE["takeout_plan_findings"])
def _(s, d):
    return joined(documented(s, d).findings.select("code", "paths"), "paths")


@query("plan_document_header", ORACLE["takeout_plan_summary"].replace("select count(*) assets", "select 2 schema_version, 'google_takeout' kind, 'export' as label, 64 fingerprint, count(*) assets", 1))
def _(s, d):
    plan = documented(s, d)
    head = plan.source.select(F.col("schema_version").cast("int"), "kind", "label", F.length("fingerprint_sha256").alias("fingerprint"))
    return head.join(F.broadcast(plan.summary))  # one row each


@query("plan_differential", f"""with {EXPORT}, seen as (select path from m), said as (select path from g union select unnest(paths) from g where n > 1), dup as (select unnest(paths) path from g where n > 1 except select path from g),
c as (select 'discovered' check_id, (select count(*) from (select * from said except select * from seen)) missing, (select count(*) from (select * from seen except select * from said)) unexpected
union all select 'duplicate', (select count(*) from dup), 0 union all select 'uploaded', (select count(*) from (select path from g except select path from m where p_partkey % 2 = 0)), (select count(*) from (select path from m where p_partkey % 2 = 0 except select path from g)))
select check_id, unexpected = 0 and (missing = 0 or check_id = 'uploaded') passed, missing, unexpected from c""")
def _(s, d):
    media, sidecars = export(s, d)
    plan = B.build_plan("google_takeout", media, sidecars)
    fact = lambda df, name: df.select(F.lit(name).alias("check_id"), "path", F.lit("").alias("value"))
    even = media.where("cast(regexp_extract(path, '([0-9]+)[.][a-z]+$', 1) as bigint) % 2 = 0")
    return C.plan_differential(plan.assets, plan.findings, fact(media, "discovered").unionByName(fact(even, "uploaded"))).where("check_id in ('discovered', 'duplicate', 'uploaded')")


@query("apple_plan", f"select path relative_path, 'd' || p_size albums, cast(p_partkey % 4 = 1 as bigint) associations, 2 + cast(p_partkey % 4 = 1 as int) proofs from {PART}")
def _(s, d):
    p = part_media(s, d).withColumn("k", ex("cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)"))
    side = p.where("k % 4 = 1").select(ex("concat(regexp_replace(path, '[.][a-z0-9]+$', ''), '.xmp')").alias("path"), F.lit("xmp").alias("kind"), F.lit(1).cast("long").alias("byte_len"), F.lit("").alias("text"))
    plan = B.build_plan("apple_photos", cut(p.select("path", F.lit(1).cast("long").alias("byte_len"), F.sha2("path", 256).alias("sha256"))), cut(side), mode="immediate")
    return plan.assets.select("relative_path", F.array_join("normalized_metadata.albums", ",").alias("albums"), F.size("metadata").cast("long").alias("associations"), F.size("evidence").alias("proofs"))


@query("picasa_plan", f"select path relative_path, 'Album ' || p_size albums, case when p_partkey % 10 = 0 then 'c' || p_partkey end description, 2 + cast(p_partkey % 10 = 0 as int) proofs from {PART}")
def _(s, d):
    p = part_media(s, d).withColumns({"k": ex("cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)"), "dir": X.parent(F.col("path"))})
    line = ex("case when k % 10 = 0 then concat('[', substring_index(path, '/', -1), ']\\ncaption=c', k) end")
    ini = p.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("x")).select(F.concat("dir", F.lit("/.picasa.ini")).alias("path"), F.lit("ini").alias("kind"), F.lit(1).cast("long").alias("byte_len"), ex("concat('[Picasa]\\nname=Album ', substr(dir, 2), '\\n', x)").alias("text"))
    plan = B.build_plan("picasa", cut(p.select("path", F.lit(1).cast("long").alias("byte_len"), F.sha2("path", 256).alias("sha256"))), cut(ini))
    n = F.col("normalized_metadata")
    return plan.assets.select("relative_path", F.array_join(n["albums"], ",").alias("albums"), n["description"].alias("description"), F.size("evidence").alias("proofs"))


@query("drift_by_tree", ORACLE["plan_drift"])
def _(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_orderstatus")
    other = o.withColumn("o_orderstatus", ex("case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end"))
    return G.drift(*[G.write_tree(x, ["o_orderkey"], shared_folder(s)) for x in (o, other)])


@query("inventory_pages_by_text", "select md5(cast(o_orderkey as varchar)) id, (row_number() over (order by md5(cast(o_orderkey as varchar))) - 1) // 1000 + 1 page from orders")
def _(s, d):
    return P.bounded_inventory(t(s, d, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("id")), 1000, 10**12, 7)


@query("xmp_binding_v1", "with b as (select l_orderkey k, count(*) every, count(*) filter (l_returnflag = 'R') n, min(case when l_returnflag = 'R' then 's' || l_partkey || '.xmp' end) x from lineitem group by 1) select 'o' || o_orderkey operation_id, case when every = 1 and n = 1 then x end xmp, case when every > 1 or every > n then 'unsupported' else 'bound' end outcome from orders left join b on o_orderkey = k")
def _(s, d):
    bridge = t(s, d, "lineitem").select(ex("concat('o', l_orderkey)").alias("operation_id"), ex("concat('s', l_partkey, case when l_returnflag = 'R' then '.xmp' else '.json' end)").alias("sidecar"))
    return M.bind_xmp(t(s, d, "orders").select(ex("concat('o', o_orderkey)").alias("operation_id")), bridge, 1)


UPLOAD = "(select o_orderkey k, sha256(cast(o_orderkey as varchar)) operation_id, case when o_orderkey % 13 = 0 then 'same' else 'p' || o_orderkey end path, o_orderkey % 7 byte_len, case when o_orderkey % 19 = 0 then 'bad' else sha256('x' || o_orderkey) end h, o_orderkey % 2 = 0 has_metadata, 'a' || o_orderkey % 5 album from orders)"


@query("whole_upload_violations", f"""with o as {UPLOAD} select 'path_unique' check_id, path as key from o group by path having count(*) > 1 union all select 'sha256', path from o where h = 'bad' union all select 'empty', path from o where byte_len = 0 union all select 'dependency', operation_id from o where k % 4 = 0 and (k % 12 = 0 or k + 1 not in (select k from o)) union all select 'summary', 'operations,max_mutations'""")
def _(s, d):
    o = t(s, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("operation_id"), ex("case when o_orderkey % 13 = 0 then 'same' else concat('p', o_orderkey) end").alias("path"), ex("o_orderkey % 7").alias("byte_len"), ex("case when o_orderkey % 19 = 0 then 'bad' else sha2(concat('x', o_orderkey), 256) end").alias("sha256"), ex("case when o_orderkey % 4 < 2 then o_orderkey div 4 end").alias("pair_id"), ex("case o_orderkey % 4 when 0 then 'image' when 1 then 'video' end").alias("role"), ex("case when o_orderkey % 4 = 0 then sha2(cast(o_orderkey + case when o_orderkey % 12 = 0 then 2 else 1 end as string), 256) end").alias("video_operation_id"), F.lit(None).cast("struct<path:string,byte_len:bigint,sha256:string>").alias("xmp"), ex("o_orderkey % 2 = 0").alias("has_metadata"), ex("array(concat('a', o_orderkey % 5))").alias("albums"))
    stated = P.import_summary(o).join(F.broadcast(o.agg(F.sum("byte_len").alias("media_bytes"), F.lit(0).alias("xmp"), F.count_if(F.col("role") == "image").alias("pairs"))))  # one row each
    return P.whole_upload_violations(o, stated.withColumn("operations", F.col("operations") + 1).withColumn("max_mutations", F.lit(-1)), 2)


@query("archive_manifest_violations", ORACLE["archive_violations"] + " union all select 'schema', '2' union all select 'identity', 'x' union all select 'summary', 'media_bytes'")
def _(s, d):
    h = t(s, d, "orders").select(F.col("o_orderkey").alias("k"), ex("sha2(cast(o_orderkey - case when o_orderkey % 17 = 0 then 1 else 0 end as string), 256)").alias("h"), F.col("o_custkey").alias("byte_len"), ex("case when o_orderkey % 13 = 0 then 'con.txt' else concat(o_orderkey, '.jpg') end").alias("original_file_name"))
    a = h.withColumn("asset_id", ex("concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', case when k % 11 = 0 then '5' else '4' end, substr(h, 14, 3), '-a', substr(h, 18, 3), '-', substr(h, 21, 12))"))
    a = a.withColumn("checksum_sha1", ex("substr(h, 1, 40)")).withColumn("target_path", ex("concat(case when k % 19 = 0 then 'other/' else 'assets/' end, asset_id, '/', original_file_name)"))
    manifest = P.archive_summary(a).select(F.lit(2).alias("schema_version"), F.sha2(F.lit("c"), 256).alias("configuration_sha256"), F.lit("x").alias("identity_sha256"), F.lit(3).alias("major"), F.lit(1).alias("minor"), "assets", (F.col("media_bytes") + 1).alias("media_bytes"))
    return P.archive_manifest_violations(a, manifest)


@query("archive_report_violations", "select 'report' check_id, case when c_custkey % 11 = 0 then 'short' else sha256(cast(c_custkey as varchar)) end as key from customer where c_custkey % 9 = 0 or c_custkey % 7 = 0 or c_custkey % 11 = 0")
def _(s, d):
    c = t(s, d, "customer")
    reports = c.select(ex("case when c_custkey % 11 = 0 then 'short' else sha2(cast(c_custkey as string), 256) end").alias("manifest_sha256"), F.lit(1).alias("schema_version"), ex("c_custkey % 10").alias("downloaded"), ex("10 - c_custkey % 10 + case when c_custkey % 7 = 0 then 1 else 0 end").alias("already_complete"))
    return P.archive_report_violations(reports, c.where("c_custkey % 9 <> 0").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("manifest_sha256"), F.lit(10).alias("assets")))


@query("operations_sink", "select o_orderkey operation_id, 'p' || o_orderkey path, o_custkey byte_len, (select count(*) from orders) operations, (select count(*) from orders) assets from orders")
def _(s, d):
    """Operations and an archive's manifest with their summaries, written and read back."""
    one, other = shared_folder(s), shared_folder(s)
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("operation_id"), ex("concat('p', o_orderkey)").alias("path"), F.col("o_custkey").alias("byte_len"))
    K.write_operations(o, o.agg(F.count("*").alias("operations")), one)
    K.write_operations(o.withColumnRenamed("operation_id", "asset_id"), P.archive_summary(o), other, manifest=True)
    K.write_report(s.read.json(f"{other}/summary"), f"{other}/report")
    totals = s.read.json(f"{one}/summary").join(F.broadcast(s.read.json(f"{other}/report").select("assets")))  # one row each
    kept = s.read.parquet(f"{other}/assets").select(F.col("asset_id").alias("operation_id"), "path")
    return s.read.parquet(f"{one}/operations").join(kept, ["operation_id", "path"]).join(F.broadcast(totals))  # one row
