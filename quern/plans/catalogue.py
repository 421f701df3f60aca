"""Catalogue queries: names, authors, tags, states, context lines, citations, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import catalogue as C
from quern.operators import signal
from quern.plans.base import Plan
from quern.sources.tables import documents, table

plan = Plan()


@plan.query("""with n as (select p_partkey, 'F' || (p_size % 9) || ['L', 'M', 'X'][(p_partkey % 3 + 1)::int] || case when p_partkey % 2 = 0 then '.csv' else '' end as name from part)
select p_partkey, case when regexp_matches(name, '^F[0-7][LM](\\.csv)?$') then substr(name, 2, 1)::int end as fault, case when regexp_matches(name, '^F[0-7][LM](\\.csv)?$') then substr(name, 3, 1) end as mode from n""")
def trial_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as trials: names with and without a suffix, and some that name no trial."""
    mode = F.element_at(F.array(F.lit("L"), F.lit("M"), F.lit("X")), (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.concat(F.lit("F"), (F.col("p_size") % 9).cast("string"), mode, F.when(F.col("p_partkey") % 2 == 0, ".csv").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", C.trial_fault(F.col("name")).alias("fault"), C.trial_mode(F.col("name")).alias("mode"))


@plan.query("""with w as (select l_orderkey, l_linenumber as s, l_linenumber + 2 as e, (count(*) over (partition by l_orderkey) + 1) / 2.0 as mid from lineitem)
select l_orderkey, s, case when l_orderkey % 4 = 0 then 'healthy' when e <= mid then 'pre_fault' when s >= mid then 'post_fault' else 'transition' end as phase from w""")
def record_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, each line a window of two places, judged against the middle of its order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("s"))
    middle = lines.groupBy("l_orderkey").agg(((F.count("*") + 1) / 2.0).alias("mid"))
    placed = lines.join(middle, "l_orderkey")
    return placed.select("l_orderkey", "s", signal.phase(F.col("s"), F.col("s") + 2, F.col("mid"), F.col("l_orderkey") % 4 == 0).alias("phase"))


NOISE_SQL = "[" + ", ".join(f"'{n}'" for n in C.NOISE) + "]"


@plan.query(f"""with n as (select conv_id, turn, concat_ws(chr(10), text, case when turn % 2 = 0 then 'Error code: 500' end, role, case when turn % 3 = 0 then 'HTTP 429, QUOTA used' end) as t from conversations)
select conv_id, turn, md5(array_to_string(list_filter(string_split(t, chr(10)), lambda x: not list_bool_or(list_transform({NOISE_SQL}, lambda n: contains(lower(x), n)))), chr(10))) as digest from n""")
def session_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with lines of failed calls between them, without these lines."""
    text = F.concat_ws("\n", "text", F.when(F.col("turn") % 2 == 0, "Error code: 500"), "role", F.when(F.col("turn") % 3 == 0, "HTTP 429, QUOTA used"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(C.without_noise(text).cast("binary")).alias("digest"))


@plan.query("""with n as (select o_orderkey, case o_orderstatus when 'F' then ' Draft ' when 'O' then 'Ativo' when 'P' then '' end as s from orders), k as (select o_orderkey, case when trim(coalesce(s, '')) = '' then 'ativo' else lower(trim(s)) end as state from n)
select o_orderkey, state, state not in ('superado', 'superseded', 'rascunho', 'draft', 'obsoleto', 'historico') as current from k""")
def note_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes whose states are written in several ways."""
    s = F.when(F.col("o_orderstatus") == "F", " Draft ").when(F.col("o_orderstatus") == "O", "Ativo").when(F.col("o_orderstatus") == "P", "")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", C.standing(s).alias("state"))
    return rows.withColumn("current", ~F.col("state").isin(C.NOT_CURRENT))


@plan.query("""select c_custkey, coalesce(lower(trim([' Sim', 'yes ', '0', '1', null][(c_custkey % 5 + 1)::int])) in ('1', 'true', 'sim', 'yes'), false) as flag,
array_to_string(list_filter(list_transform(string_split(c_mktsegment || ', ,' || c_name || ' ,', ','), lambda x: trim(x)), lambda x: x <> ''), '|') as items from customer""")
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and lists as people write them in front matter."""
    flag = F.element_at(F.array(F.lit(" Sim"), F.lit("yes "), F.lit("0"), F.lit("1"), F.lit(None).cast("string")), (F.col("c_custkey") % 5 + 1).cast("int"))
    items = C.listed(F.concat("c_mktsegment", F.lit(", ,"), "c_name", F.lit(" ,")))
    return table(spark, sf_dir, "customer").select("c_custkey", C.truth(flag).alias("flag"), F.array_join(items, "|").alias("items"))


AUTHORED = "with a as (select p_partkey, p_type, p_size, case when p_partkey % 4 = 0 then p_name || '; ' || p_brand || ' ;' || p_name when p_partkey % 4 = 1 then ' ; ' else p_name end as w from part), "


def authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    value = F.when(k == 0, F.concat("p_name", F.lit("; "), "p_brand", F.lit(" ;"), "p_name")).when(k == 1, " ; ").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", C.authors_of(value).alias("authors"))


@plan.query(AUTHORED + """y as (select *, case when p_partkey % 4 = 0 then 2 else 1 end as n, 1700 + p_size * 5 as year from a)
select p_partkey, n::int as n_authors, case when p_partkey % 4 = 1 then 'Autor desconhecido' else trim(string_split(w, ';')[1]) end || case when n > 1 then ' et al.' else '' end || ' (' || case when year >= 1800 then year::varchar else 's.d.' end || ') — ' || p_type as citation from y""")
def author_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as works: authors parted by semicolons, some repeated or missing, and years out of range."""
    year = C.year_of((F.col("p_size") * 5 + 1700).cast("string"))
    return authored(spark, sf_dir).select("p_partkey", F.size("authors").alias("n_authors"), C.citation(F.col("authors"), year, F.col("p_type")).alias("citation"))


@plan.query(AUTHORED + """e as (select distinct p_partkey, case when trim(x) = '' then 'Autor desconhecido' else trim(x) end as author from (select p_partkey, unnest(string_split(w, ';')) as x from a)), c as (select author, count(*) as files from e group by 1)
select distinct token, author, files from (select author, files, unnest(string_split_regex(lower(author), '[^a-z0-9]+')) as token from c) where length(token) >= 3""")
def author_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a word of a name stands for: canonical authors, and how many works each has."""
    return C.author_index(authored(spark, sf_dir), "p_partkey", "authors")


@plan.query("""with t as (select c_custkey, list_transform(['#' || c_mktsegment, ' #Análise Técnica! ', c_name], lambda x: regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(trim(x))), '^#+', ''), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g')) as tags from customer)
select c_custkey, array_to_string(list_sort(list_filter(tags, lambda x: x in ('analise-tecnica', 'building', 'machinery'))), ' ') as kept, array_to_string(list_sort(list_filter(tags, lambda x: x not in ('analise-tecnica', 'building', 'machinery'))), ' ') as unknown from t""")
def tag_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' tags: those a taxonomy knows and the rest."""
    known = F.array(*[F.lit(t) for t in ("analise-tecnica", "building", "machinery")])
    tags = F.array(C.tag(F.concat(F.lit("#"), "c_mktsegment")), C.tag(F.lit(" #Análise Técnica! ")), C.tag(F.col("c_name")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", tags.alias("tags"))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    return rows.select("c_custkey", joined(F.array_intersect("tags", known)).alias("kept"), joined(F.array_except("tags", known)).alias("unknown"))


@plan.query("""with t as (select page_id, regexp_replace(regexp_replace(coalesce(url, ''), '[<>:"/\\\\|?*\\n\\r\\t]', '', 'g'), '^[ .]+|[ .]+$', '', 'g') as t from pages) select page_id, substr(case when t = '' then 'Nota sem titulo' else t end, 1, 120) as title from t""")
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.note_title(F.col("url")).alias("title"))


@plan.query("""with c as (select doc_id, text, concat_ws(chr(10), case when source <> '' then 'Colecao: ' || source end, case when doc_id % 3 <> 0 then 'Ano: ' || (1990 + doc_id % 40) end, case when lang <> '' then 'Idioma: ' || substr(lang, 1, 12) end) as c from documents)
select doc_id, md5(case when c = '' then text else 'Contexto documental deterministico:' || chr(10) || c || chr(10) || chr(10) || 'Trecho original:' || chr(10) || text end) as digest from c""")
def context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line for each field they have before their text."""
    year = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 40 + 1990)
    lines = C.context_lines([("Colecao", F.col("source"), 120), ("Ano", year, 12), ("Idioma", F.col("lang"), 12)])
    return documents(spark, sf_dir).select("doc_id", F.md5(C.retrieval_text(lines, F.col("text")).cast("binary")).alias("digest"))


@plan.query("select o_orderkey, array_to_string(case when a > 0 then generate_series(a, greatest(a, coalesce(b, a))) else [] end, ',') as pages from (select o_orderkey, (o_custkey % 9 - 1)::int as a, case when o_orderkey % 5 <> 0 then (o_custkey % 7)::int end as b from orders)")
def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of pages written out; some have no end, some end before they begin, some have no first page."""
    first = (F.col("o_custkey") % 9 - 1).cast("int")
    last = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 7).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(C.page_list(first, last).cast("array<string>"), ",").alias("pages"))


@plan.query("""with r as (select o_orderkey, case o_orderkey % 4 when 0 then [] when 1 then ['x', 'F9'] else [' f' || (o_custkey % 5 + 1), 'F2', '?'] end as u, o_orderstatus = 'F' as bad from orders),
p as (select *, list_filter(list_transform(u, lambda x: try_cast(nullif(regexp_extract(trim(x), '^[Ff]([0-9]+)$', 1), '') as int)), lambda k: k between 1 and 4) as places from r)
select o_orderkey, array_to_string(case when len(u) = 0 then case when bad then [] else ['a', 'b', 'c'] end when len(places) = 0 then ['a', 'b', 'c', 'd'] else list_filter(['a', 'b', 'c', 'd'], lambda x, i: list_contains(places, i)) end, '') as stands from p""")
def audited_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four citations against audits that name some, none, or labels nobody can read."""
    k = F.col("o_orderkey") % 4
    named = F.array(F.concat(F.lit(" f"), (F.col("o_custkey") % 5 + 1).cast("string")), F.lit("F2"), F.lit("?"))
    usable = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("x"), F.lit("F9"))).otherwise(named)
    four = F.array(*[F.lit(c) for c in "abcd"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(C.audited(four, usable, F.col("o_orderstatus") == "F"), "").alias("stands"))


@plan.query("""select p_partkey, '| ' || p_name || ' | ' || case when p_partkey % 7 = 0 then '-' else printf('%.3f', p_retailprice) end || ' | ' || case when p_size < 5 then 'p<0.0001' else 'p=' || printf('%.4f', p_size / 50000.0) end || ' |' as shown from part""")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table of results: names, figures with fixed places, p-values."""
    price = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
    row = C.markdown_row(F.col("p_name"), C.shown_number(price, 3), C.shown_p(F.col("p_size") / 50000.0))
    return table(spark, sf_dir, "part").select("p_partkey", row.alias("shown"))


@plan.query("""with l as (select doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 20) as l from documents)
select doc_id, coalesce(nullif(regexp_extract(text, '\\b(199[0-9]|20[0-3][0-9])\\b', 1), ''), '0000') as year, md5(substr(coalesce(l[1], ''), 1, 120)) as title from l""")
def found_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year and the title that a document's own text tells."""
    return documents(spark, sf_dir).select("doc_id", C.found_year(F.col("text")).alias("year"), F.md5(C.found_title(F.col("text")).cast("binary")).alias("title"))


@plan.query("""select s_suppkey, (s_suppkey % 4 <> 0) and (s_suppkey % 7 <> 0) and (s_nationkey % 3 <> 0 or s_acctbal < 0) as resolved from supplier""")
def resolved_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records that lack an author, a title or a year, some of them with no year to be had."""
    k = F.col("s_suppkey")
    author = F.when(k % 4 == 0, " Desconhecido").otherwise(F.col("s_name"))
    year = F.when(F.col("s_nationkey") % 3 == 0, "0000").otherwise(F.lit("1999"))
    return table(spark, sf_dir, "supplier").select(k, C.resolved(author, F.when(k % 7 != 0, "t"), year, F.col("s_acctbal") < 0).alias("resolved"))


@plan.query("""with e as (select distinct l_partkey as part, l_linenumber as place from lineitem where l_quantity > 10), f as (select distinct l_partkey as part, l_linenumber as place from lineitem where l_discount < 0.05)
select *, 'missing' as side from (select * from e except select * from f) union all select *, 'unexpected' from (select * from f except select * from e)""")
def contract_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of (part, place) and what either lacks of the other."""
    rows = table(spark, sf_dir, "lineitem")
    pair = [F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("place")]
    return C.differences(rows.where("l_discount < 0.05").select(*pair), rows.where("l_quantity > 10").select(*pair))


@plan.query("""with f as (select l_orderkey, l_suppkey, min(l_linenumber) as first from lineitem group by all), p as (select *, row_number() over (partition by l_orderkey order by first, l_suppkey) as place from f) select l_orderkey, l_suppkey, place, place || '. ' || l_suppkey as line from p""")
def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order as its sources, each listed once, by first mention."""
    return C.cited(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey"], "l_suppkey", "l_linenumber")


@plan.query("""select substr(sha256(text), 1, 16) as key, arg_min(conv_id, conv_id * 100000 + turn) as conv_id, arg_min(turn, conv_id * 100000 + turn) as turn, count(*) as uses from conversations where text is not null group by 1""")
def snippet_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim texts of turns, each kept once under its key."""
    return C.snippets(table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"])


@plan.query("""with g as (select lang, source, count(*) as held from documents group by all) select lang, source, held, row_number() over (partition by lang order by lower(source), source) as place from g""")
def library_shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language in catalogue order, and how many documents each holds."""
    from pyspark.sql import Window

    held = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("held"))
    return held.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.lower("source"), "source")))
