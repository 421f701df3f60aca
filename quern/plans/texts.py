"""Text queries: normalising, chunks, duplicates, excerpts, names, secrets, citations, trust."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import corpus as C
from quern.plans.base import Plan
from quern.sources import snapshots
from quern.sources.tables import documents, table

plan = Plan()
SQUEEZE = "trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g'))"
SEARCH = "trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@plan.query(f"select doc_id, md5({SQUEEZE}) as squeezed, md5({SEARCH}) as searchable from documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.md5(T.squeeze(F.col("text")).cast("binary")).alias("squeezed"), F.md5(T.searchable(F.col("text")).cast("binary")).alias("searchable"))




def _marks(words: list[str]) -> str:
    return "len(list_filter(string_split(" + SEARCH + ", ' '), lambda x: x in (" + ", ".join(f"'{w}'" for w in words) + ")))"


@plan.query("with c as (select doc_id, " + ", ".join(f"{_marks(w)} as {k}" for k, w in C.LANGUAGE_MARKS.items()) + " from documents) select doc_id, case when greatest(en, fr, de, es) = 0 then 'unknown' when en >= greatest(fr, de, es) then 'en' when fr >= greatest(de, es) then 'fr' when de >= es then 'de' else 'es' end as language from c")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", C.language(F.col("text")).alias("language"))


@plan.query("with c as (select doc_id, " + ", ".join(f"{_marks(w)} as {k}" for k, w in C.THEMES.items()) + " from documents) select doc_id, case when greatest(motion, place, being) = 0 then 'general' when motion >= greatest(place, being) then 'motion' when place >= being then 'place' else 'being' end as theme from c")
def theme_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", C.best_class(F.col("text"), C.THEMES, "general").alias("theme"))


@plan.query("""with x as (select doc_id, text, unnest(range(0, greatest(length(text) - 100, 1), 900)) as start from documents where length(text) > 0)
select doc_id, (start // 900)::int as chunk_index, length(substr(text, start + 1, 1000)) as n_chars, md5(substr(text, start + 1, 1000)) as digest from x""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = C.fixed_chunks(documents(spark, sf_dir).where("length(text) > 0").select("doc_id", "text"), 1000, 100)
    return chunks.select("doc_id", "chunk_index", F.char_length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


@plan.query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.semantic_chunks(documents(spark, sf_dir).select("doc_id", "text"), 1200, 150, 80)


KEY = "sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))"


@plan.query(f"select doc_id, key from (select doc_id, {KEY} as key, row_number() over (partition by {KEY} order by doc_id) as k from documents) where k = 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_of_equal(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "key")


@plan.query("with h as (select doc_id, sha256(text) as h from documents) select doc_id, h as sha256, exists (select 1 from h o where o.h = h.h and o.doc_id < h.doc_id) as indexed from h")
def doc_hash_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    first = h.groupBy("sha256").agg(F.min("doc_id").alias("first"))
    return h.join(first, "sha256").select("doc_id", "sha256", (F.col("first") < F.col("doc_id")).alias("indexed"))


@plan.query("select count(*) as rows, count(distinct doc_id) as ids, sum(('0x' || substr(sha256(text), 1, 13))::bigint)::hugeint::varchar as digest from documents")
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.conv(F.substring(F.sha2("text", 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"), F.sum(part).cast("string").alias("digest"))


@plan.query(f"""with f as (select doc_id, {FLAT} as t from documents)
select doc_id, case when length(t) <= 200 then t when length(regexp_extract(substr(t, 1, 200), '^(.*[.!?])', 1)) >= 110 then regexp_extract(substr(t, 1, 200), '^(.*[.!?])', 1) else regexp_replace(substr(t, 1, 200), '\\s\\S*$', '') end as excerpt from f""")
def excerpt_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 200).alias("excerpt"))


@plan.query(f"""with s as (select doc_id, unnest(string_split({FLAT}, '. ')) as s, generate_subscripts(string_split({FLAT}, '. '), 1) as i from documents),
c as (select doc_id, i, s, len(list_intersect(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(s)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), ['the', 'and', 'was'])) as k from s where length(s) >= 40)
select doc_id, md5(max_by(s, k * 1000000 - i)) as digest from c group by doc_id""")
def best_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    wanted = F.array(*[F.lit(w) for w in ("the", "and", "was")])
    parts = F.filter(F.split(flat, r"\. "), lambda s: F.char_length(s) >= 40)
    places = F.transform(F.split(flat, r"\. "), lambda s, i: F.when(F.char_length(s) >= 40, F.struct(F.size(F.array_intersect(T.terms(s), wanted)).alias("k"), (-i).alias("i"), s.alias("s"))))
    d = documents(spark, sf_dir).where(F.size(parts) > 0)
    return d.select("doc_id", F.md5(F.array_max(places)["s"].cast("binary")).alias("digest"))


@plan.query("with s as (select p_partkey, replace(trim(regexp_replace(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ', '-') as s from part) select p_partkey, case when length(s) <= 12 then s else regexp_replace(substr(s, 1, 13), '-[^-]*$', '') end as slug from s")
def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name"), 12).alias("slug"))


MASK = """regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b((?:password|passwd|secret|token|api_key)\\s*[=:]\\s*)(\\S{1,6})\\S*', '\\1\\2***', 'g'), '\\b(AKIA[0-9A-Z]{2})[0-9A-Z]{10,}', '\\1***', 'g'), '\\b((?:sk|ghp|gsk)[-_][A-Za-z0-9]{3})[A-Za-z0-9_-]{10,}', '\\1***', 'g')"""


@plan.query(f"select doc_id, {MASK} <> text as has_secret, md5({MASK}) as masked from documents")
def secret_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.has_secret(F.col("text")).alias("has_secret"), F.md5(T.mask_secrets(F.col("text")).cast("binary")).alias("masked"))


@plan.query("with f as (select doc_id, list_distinct(regexp_extract_all(text, '\\b([A-Z]{2,5}[- ]\\d{2,5})\\b', 1)) as f from documents) select doc_id, len(f) as n_named, len(list_filter(f, lambda x: not regexp_matches(x, '^(ISO|IEC)'))) as n_unlisted from f")
def standards_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{2,5}[- ]\d{2,5})\b"), F.lit(1)))
    d = table(spark, sf_dir, "documents").select("doc_id", found.alias("f"))
    return d.select("doc_id", F.size("f").cast("long").alias("n_named"), F.size(F.filter("f", lambda x: ~x.rlike("^(ISO|IEC)"))).cast("long").alias("n_unlisted"))


@plan.query("select page_id, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) as n_links, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))), ' ')) as digest from pages")
def link_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.md5(F.array_join(F.array_sort(links), " ").cast("binary")).alias("digest"))


@plan.query("""with h as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from pages)
select page_id, case when regexp_matches(host, '\\.(gov|edu|int)(\\.[a-z]{2})?$') then 'A' when regexp_matches(host, '\\.org(\\.[a-z]{2})?$') then 'B' when regexp_matches(host, '\\.com(\\.[a-z]{2})?$') then 'C' else 'D' end as level from h""")
def trust_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.trust_level(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).alias("level"))


@plan.query("with p as (select source, doc_id, doc_id - row_number() over (partition by source order by doc_id) as run from documents), r as (select source, min(doc_id) as a, max(doc_id) as b from p group by source, run) select source, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as ranges from r group by source")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    # gaps and islands first, so a row a run and not a row a page is gathered
    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("doc_id") - F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).alias("run"))
    runs = d.groupBy("source", "run").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    v = runs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))).alias("v"))
    return v.select("source", F.array_join(F.transform("v", lambda x: x["s"]), ", ").alias("ranges"))


@plan.query("with s as (select source, lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by all) select source, sum(n)::bigint as documents, sum(chars)::bigint as chars, count(*) as languages, max_by(lang, n * 1000 + ascii(lang)) as main from s group by source")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return s.groupBy("source").agg(F.sum("n").alias("documents"), F.sum("chars").alias("chars"), F.count("*").alias("languages"), F.max_by("lang", F.col("n") * 1000 + F.ascii("lang")).alias("main"))


@plan.query("select d.doc_id, coalesce(case when l.quality = 0 then 'junk' end, case when d.lang = 'en' then 'english' end, d.source) as category, (l.doc_id is null)::int as alerts from documents d left join labels l using (doc_id)")
def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("seen"))
    category = F.coalesce(F.when(F.col("quality") == 0, "junk"), F.when(F.col("lang") == "en", "english"), F.col("source"))
    return d.join(lab, "doc_id", "left").select("doc_id", category.alias("category"), F.col("seen").isNull().cast("int").alias("alerts"))


@plan.query("select doc_id, concat_ws(',', case when doc_id is null then 'id' end, case when coalesce(text, '') = '' then 'text' end, case when n_chars <> length(text) then 'n_chars' end, case when lang not in ('en', 'fr', 'de', 'es') then 'lang' end) as broken from documents")
def snapshot_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda bad, name: F.when(bad, name)
    broken = F.concat_ws(",", rule(F.col("doc_id").isNull(), "id"), rule(F.coalesce("text", F.lit("")) == "", "text"), rule(F.col("n_chars") != F.char_length("text"), "n_chars"), rule(~F.col("lang").isin("en", "fr", "de", "es"), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", broken.alias("broken"))


@plan.query("select l.doc_id, case when d.doc_id is null then 'missing' when l.quality not in (0, 1) then 'range' else 'ok' end as state from labels l left join documents d using (doc_id)")
def gold_referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("seen"))
    state = F.when(F.col("seen").isNull(), "missing").when(~F.col("quality").isin(0, 1), "range").otherwise("ok")
    return table(spark, sf_dir, "labels").join(d, "doc_id", "left").select("doc_id", state.alias("state"))


DIGEST = "sum(('0x' || substr(sha256({}), 1, 13))::bigint)::hugeint::varchar"


@plan.query(f"""with o as (select source as artefact, {DIGEST.format(FLAT)} as h from documents join labels using (doc_id) group by 1 union all select 'lang-' || lang, {DIGEST.format(FLAT)} from documents group by 1),
n as (select source as artefact, {DIGEST.format('text')} as h from documents group by 1 union all select 'lang-' || lang, {DIGEST.format('text')} from documents group by 1)
select artefact, case when o.h is null then 'pending' when n.h is null or n.h <> o.h then 'stale' else 'ready' end as state from o full join n using (artefact)""")
def manifest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests recorded of squeezed texts, by source of the labelled and by language of all, against those of the texts as they are."""
    d = documents(spark, sf_dir)
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))

    def digests(rows, by, text):
        part = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("decimal(38,0)")
        return rows.groupBy(by.alias("artefact")).agg(F.sum(part).cast("string").alias("hash"))

    lang = F.concat(F.lit("lang-"), "lang")
    old = digests(d.join(table(spark, sf_dir, "labels"), "doc_id"), F.col("source"), flat).union(digests(d, lang, flat))
    new = digests(d, F.col("source"), F.col("text")).union(digests(d, lang, F.col("text")))
    return C.artefact_states(old, new)


@plan.query("""with h as (select doc_id as id, sha256(text) as h from documents), o as (select id, h from h where id % 3 <> 0 or id % 7 = 0), n as (select id, case when id % 5 = 0 then sha256(h) else h end as h from h where id % 7 <> 0)
select id, case when id % 11 = 0 then 'keep' when o.h = n.h then 'keep' when o.h is null then 'insert' when n.h is null then 'delete' else 'update' end as action from o full join n using (id)""")
def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    new = h.where("id % 7 <> 0").withColumn("hash", F.when(F.col("id") % 5 == 0, F.sha2("hash", 256)).otherwise(F.col("hash")))
    return snapshots.sync(h.where("id % 3 <> 0 or id % 7 = 0"), new, h.where("id % 11 = 0"))
