"""Queries: text expressions, chart families and image lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.functions import images as im
from chartspark.functions import taxonomy, text as tx
from chartspark.operators import columns as cols
from chartspark.plans import views as v
from chartspark.plans.registry import register

BLANK = r"[\t-\r \x1c-\x1f\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def type_text_sql(x: str) -> str:
    spaced = f"translate(lower({strip_sql(x)}), '_-', '  ')"
    letters = f"regexp_replace({spaced}, '[^a-z0-9/\\t-\\r \\x{{85}}\\p{{Z}}]', ' ', 'g')"
    return strip_sql(f"regexp_replace({letters}, '{BLANK}+', ' ', 'g')")


def identifier_sql(x: str) -> str:
    camel = f"regexp_replace(replace({x}, '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(replace(lower({camel}), '''s', ''), '[^a-z0-9]+', ' ', 'g'))"


def rules_sql(text: str, raw: str) -> str:
    arms = [f"when {text} = '' then 'Unknown'"]
    for family, parts, wholes in taxonomy.FAMILY_RULES:
        tests = [f"contains({text}, '{p}')" for p in parts] + [f"{text} = '{w}'" for w in wholes]
        arms.append(f"when {' or '.join(tests)} then '{family}'")
    return f"case {' '.join(arms)} else {strip_sql(raw)} end"


def spelling_sql(raw: str) -> str:
    arms = " ".join(f"when '{k}' then '{f}'" for k, f in taxonomy.FAMILY_OF_SPELLING.items())
    return (f"coalesce(case lower({strip_sql(raw)}) {arms} end, "
            f"case when {strip_sql(raw)} = '' then 'Unknown' else {strip_sql(raw)} end)")


@register("prj7_family_by_rules", v.ctes(v.CHARTS) + f""", t as (
  select chart_id, raw_type, {type_text_sql('raw_type')} as tt from charts_v)
select chart_id, raw_type, {rules_sql('tt', 'raw_type')} as family from t""")
def family_by_rules(spark, sf):
    return v.charts_v(spark, sf).select("chart_id", "raw_type", taxonomy.family_by_rules(F.col("raw_type")).alias("family"))


@register("prj7_family_of_text", f"""
with t as (select doc_id, text, {type_text_sql('text')} as tt from documents)
select doc_id, {rules_sql('tt', 'text')} as family from t""")
def family_of_text(spark, sf):
    docs = v.table(spark, sf, "documents")
    return docs.select("doc_id", taxonomy.family_by_rules(F.col("text")).alias("family"))


@register("prj8_family_by_spelling", v.ctes(v.CHARTS) + f"""
select chart_id, {spelling_sql('raw_type')} as family from charts_v""")
def family_by_spelling(spark, sf):
    return v.charts_v(spark, sf).select("chart_id", taxonomy.family_by_spelling(F.col("raw_type")).alias("family"))


@register("prj9_type_text", f"select doc_id, {type_text_sql('text')} as type_text from documents")
def type_text(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tx.type_text(F.col("text")).alias("type_text"))


FIRST = strip_sql(f"split_part({strip_sql('text')}, '. ', 1)")
SENTENCE = strip_sql(f"split_part({strip_sql('text')}, '.', 1)")


@register("prj10_dataset_labels", f"""
with t as (select doc_id, {FIRST} as a, replace({FIRST}, chr(10), ' ') as b, replace({SENTENCE}, chr(10), ' ') as c
           from documents)
select doc_id,
       case when a = '' then '(no description)' else left(a, 120) end as label_120,
       case when b = '' then '(no description)' when length(b) > 70 then left(b, 67) || '...' else b end as label_short,
       case when c = '' then '(no description)' when length(c) > 70 then left(c, 67) || '…' else c end as label_sentence
from t""")
def dataset_labels(spark, sf):
    text = F.col("text")
    return v.table(spark, sf, "documents").select(
        "doc_id", tx.label_120(text).alias("label_120"), tx.label_short(text).alias("label_short"),
        tx.label_sentence(text).alias("label_sentence"),
    )


@register("prj14_join_url", """
select page_id,
       rtrim(url, '/') || '/' || ltrim('/detail/' || page_id, '/') as detail_url,
       case when page_id % 3 = 0 then null
            else rtrim('http://host/', '/') || '/' || ltrim('charts/' || page_id || '/', '/') end as thumb_url
from pages""")
def join_url(spark, sf):
    name = F.col("page_id").cast("string")
    base = F.when(F.col("page_id") % 3 != 0, F.lit("http://host/")).otherwise("")
    return v.table(spark, sf, "pages").select(
        "page_id",
        tx.join_url(F.col("url"), F.concat(F.lit("/detail/"), name)).alias("detail_url"),
        tx.join_url(base, F.concat(F.lit("charts/"), name, F.lit("/"))).alias("thumb_url"),
    )


REPLIES = """replies as (
  select conv_id, turn, case turn % 3 when 0 then '<think>' || role || '</think> ' || text || ' '
                                      when 1 then role || ' </think>' || text else ' ' || text end as reply
  from conversations)"""


def replies(spark, sf):
    third = F.col("turn") % 3
    reply = (
        F.when(third == 0, F.concat(F.lit("<think>"), "role", F.lit("</think> "), "text", F.lit(" ")))
        .when(third == 1, F.concat("role", F.lit(" </think>"), "text"))
        .otherwise(F.concat(F.lit(" "), "text"))
    )
    return v.table(spark, sf, "conversations").select("conv_id", "turn", reply.alias("reply"))


BEFORE = "left(reply, strpos(reply, '</think>') - 1)"
AFTER = "substr(reply, strpos(reply, '</think>') + 8)"


@register("prj15_split_reasoning", v.ctes(REPLIES) + f"""
select conv_id, turn,
       case when contains(reply, '</think>') then {strip_sql(f"replace({BEFORE}, '<think>', '')")} end as thought,
       case when contains(reply, '</think>') then {strip_sql(AFTER)} else reply end as answer
from replies""")
def split_reasoning(spark, sf):
    return replies(spark, sf).select("conv_id", "turn", F.inline(F.array(tx.split_reasoning(F.col("reply")))))


@register("prj16_after_reasoning", v.ctes(REPLIES) + f""", mixed as (
  select conv_id, turn, case when conv_id % 5 = 0 then '<think>' || reply else reply end as reply from replies)
select conv_id, turn,
       case when contains(reply, '<think>') and contains(reply, '</think>') then {BEFORE} end as thought,
       case when not contains(reply, '<think>') then reply when contains(reply, '</think>') then {AFTER} end as answer,
       contains(reply, '<think>') and not contains(reply, '</think>') as failed
from mixed""")
def after_reasoning(spark, sf):
    mixed = replies(spark, sf).withColumn(
        "reply", F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("<think>"), "reply")).otherwise(F.col("reply"))
    )
    return mixed.select("conv_id", "turn", F.inline(F.array(tx.after_reasoning(F.col("reply")))))


@register("prj17_strip_fences", f"""
with fenced as (select conv_id, turn, ' ```' || case turn % 3 when 0 then 'json' when 1 then 'python' else '' end
                       || chr(10) || text || chr(10) || '``` ' as reply from conversations)
select conv_id, turn,
       {strip_sql(f"regexp_replace(regexp_replace({strip_sql('reply')}, '^```(json|python)?{BLANK}*', ''), '{BLANK}*```$', '')")} as stripped,
       replace(replace(reply, '```json', ''), '```', '') as dropped
from fenced""")
def strip_fences(spark, sf):
    third = F.col("turn") % 3
    mark = F.when(third == 0, "json").when(third == 1, "python").otherwise("")
    reply = F.concat(F.lit(" ```"), mark, F.lit("\n"), "text", F.lit("\n``` "))
    return v.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.strip_fences(reply).alias("stripped"), tx.drop_json_fences(reply).alias("dropped")
    )


@register("prj18_array_slice", """
with given as (select conv_id, turn, text || case when turn % 2 = 0 then ' [{"q": ' || turn || '}, ["x"]] tail' else '' end as reply
               from conversations)
select conv_id, turn, regexp_extract(reply, '(?s)(\\[.*\\])', 1) as sliced from given""")
def array_slice(spark, sf):
    tail = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(' [{"q": '), F.col("turn").cast("string"), F.lit('}, ["x"]] tail')))
    reply = F.concat("text", F.coalesce(tail, F.lit("")))
    return v.table(spark, sf, "conversations").select("conv_id", "turn", tx.array_slice(reply).alias("sliced"))


@register("prj19_verdict", """
with said as (select event_id, case event_id % 5 when 0 then ' TRUE ' when 1 then 'false' || chr(10) when 2 then 'true.'
                                                 when 3 then 'True' else event_type end as reply from events)
select event_id, case lower(trim(reply, ' ' || chr(10))) when 'true' then true when 'false' then false end as verdict
from said""")
def verdict(spark, sf):
    fifth = F.col("event_id") % 5
    reply = (
        F.when(fifth == 0, " TRUE ").when(fifth == 1, "false\n").when(fifth == 2, "true.").when(fifth == 3, "True")
        .otherwise(F.col("event_type"))
    )
    return v.table(spark, sf, "events").select("event_id", tx.verdict(reply).alias("verdict"))


@register("prj20_token_estimates", """
select doc_id, length(text) // 4 as text_tokens,
       round(167 + cast(0.000972 as double) * (doc_id % 1000 + 200) * n_chars, 6) as image_tokens
from documents""")
def token_estimates(spark, sf):
    width, height = F.col("doc_id") % 1000 + 200, F.col("n_chars")
    return v.table(spark, sf, "documents").select(
        "doc_id", tx.text_tokens(F.col("text")).alias("text_tokens"),
        F.round(tx.image_tokens(width, height), 6).alias("image_tokens"),
    )


@register("prj22_mime_and_key", v.ctes(v.IMAGES) + """, named as (
  select chart_id, pos, replace(path, '.png', case pos % 4 when 0 then '.PNG' when 1 then '.jpg' when 2 then '.webp' else '.bmp' end) as path
  from images_v)
select chart_id, pos, case when lower(split_part(path, '.', -1)) in ('png', 'jpg', 'jpeg', 'gif', 'webp')
                           then 'image/' || lower(split_part(path, '.', -1)) else 'image/jpeg' end as mime,
       chart_id || path as prompt_key
from named""")
def mime_and_key(spark, sf):
    quarter = F.col("pos") % 4
    ending = F.when(quarter == 0, ".PNG").when(quarter == 1, ".jpg").when(quarter == 2, ".webp").otherwise(".bmp")
    path = F.replace(F.col("path"), F.lit(".png"), ending)
    return v.images_v(spark, sf).select(
        "chart_id", "pos", tx.mime_type(path).alias("mime"), tx.prompt_key(F.col("chart_id"), path).alias("prompt_key")
    )


@register("prj24_identifier_text", f"""
select p_partkey, {identifier_sql("p_type || '_' || p_name || 'Of' || p_brand || '''s-Size'")} as words from part
union all select doc_id + 1000000000, {identifier_sql('text')} from documents""")
def identifier_text(spark, sf):
    name = F.concat("p_type", F.lit("_"), "p_name", F.lit("Of"), "p_brand", F.lit("'s-Size"))
    parts = v.table(spark, sf, "part").select("p_partkey", tx.identifier_text(name).alias("words"))
    docs = v.table(spark, sf, "documents").select(F.col("doc_id") + 1_000_000_000, tx.identifier_text(F.col("text")))
    return parts.union(docs)


STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@register("prj25_meaningful_tokens", f"""
select doc_id, cast(i - 1 as bigint) as pos, token from (
  select doc_id, unnest(list_filter(string_split({identifier_sql('text')}, ' '), lambda x: x <> '' and x not in ({STOP_SQL}))) as token,
         generate_subscripts(list_filter(string_split({identifier_sql('text')}, ' '), lambda x: x <> '' and x not in ({STOP_SQL})), 1) as i
  from documents) t""")
def meaningful_tokens(spark, sf):
    docs = v.table(spark, sf, "documents")
    out = docs.select("doc_id", F.posexplode(tx.meaningful_tokens(F.col("text"))).alias("pos", "token"))
    return out.withColumn("pos", F.col("pos").cast("long"))


ALIAS_TEXT = "source || ' (' || lang || ' text), ' || text || ' The target attribute is a class representing ' || lang || ' use, kept.'"


@register("prj26_description_aliases", f"""
with d as (select doc_id, {ALIAS_TEXT} as description from documents),
named as (select doc_id, unnest(regexp_extract_all(description, '\\b([A-Za-z][A-Za-z0-9_]*)\\s*\\(([^()]+)\\)', 1)) as raw,
                 unnest(regexp_extract_all(description, '\\b([A-Za-z][A-Za-z0-9_]*)\\s*\\(([^()]+)\\)', 2)) as alias from d),
meant as (select doc_id, 'kind' as raw,
                 unnest(regexp_extract_all(description, '(?i)target attribute[^.]*?representing\\s+([^.,;]+)', 1)) as alias from d)
select * from named union all select * from meant""")
def description_aliases(spark, sf):
    text = F.concat("source", F.lit(" ("), "lang", F.lit(" text), "), "text",
                    F.lit(" The target attribute is a class representing "), "lang", F.lit(" use, kept."))
    docs = v.table(spark, sf, "documents").select("doc_id", text.alias("description"))
    return docs.select("doc_id", F.inline(tx.description_aliases(F.col("description"), F.lit("kind"))))


@register("prj27_needed_columns", v.ctes(v.REC_IMAGES) + """, listed as (
  select doc_id, 0 as k, unnest([source, lang, source]) as name from documents
  union all select doc_id, 1 + pos, source from rec_images),
firsts as (select doc_id, name, min(case when k = 0 and name = source_of then 0 when k = 0 then 1 else 2 end) as place
           from (select l.*, d.source as source_of from listed l join documents d using (doc_id)) x group by 1, 2)
select doc_id, name, row_number() over (partition by doc_id order by place) - 1 as pos from firsts""")
def needed_columns(spark, sf):
    records = v.records_v(spark, sf)
    code = F.array_join(F.transform("images", lambda x: x["code"]), "\n")
    expected = F.array(F.col("dataset.id"), F.get(F.split("graph.short_description", " "), F.lit(1)), F.col("dataset.id"))
    out = records.select(F.col("id").cast("long").alias("doc_id"), F.posexplode(tx.needed_columns(expected, code)).alias("pos", "name"))
    return out.withColumn("pos", F.col("pos").cast("long"))


@register("prj29_replace_names", """
select doc_id, replace(replace(text, 'the', 'die'), lang, source) as description,
       case when doc_id % 2 = 0 then replace(replace(source, 'web', 'net'), 'net', lang) else source end as feature
from documents""")
def replace_names(spark, sf):
    old, new = F.array(F.lit("web"), F.lit("net")), F.array(F.lit("net"), F.col("lang"))
    uneven = F.array(F.lit("net"))
    return v.table(spark, sf, "documents").select(
        "doc_id",
        tx.replace_names(F.col("text"), F.array(F.lit("the"), F.col("lang")), F.array(F.lit("die"), F.col("source"))).alias("description"),
        tx.replace_names(F.col("source"), old, F.when(F.col("doc_id") % 2 == 0, new).otherwise(uneven)).alias("feature"),
    )


@register("prj29_rename_columns", "select n_nationkey as nation_key, n_name as nation_name, n_regionkey as region_key from nation")
def rename_columns(spark, sf):
    return cols.rename_columns(v.table(spark, sf, "nation"), ["nation_key", "nation_name", "region_key"])


@register("prj30_renamed_copies", """
select s_suppkey, s_name, s_nationkey, s_acctbal, s_acctbal as balance, s_nationkey as nation from supplier""")
def renamed_copies(spark, sf):
    pairs = {"balance": "s_acctbal", "nation": "s_nationkey", "s_name": "s_suppkey", "lost": "no_such_column"}
    return cols.add_renamed_copies(v.table(spark, sf, "supplier"), pairs)


@register("prj31_labelled_questions", v.ctes(v.REC_QUESTIONS) + """
select chart_id, pos, question, case when chart_id % 4 + 1 = 3 then ['metadata', 'trends', 'reasoning'][pos + 1] end as qtype
from rec_questions""")
def labelled_questions(spark, sf):
    labels = F.array(F.lit("metadata"), F.lit("trends"), F.lit("reasoning"))
    records = v.records_v(spark, sf)
    labelled = im.labelled_questions(F.col("graph.questions"), labels)
    out = records.select(F.col("id").cast("long").alias("chart_id"), F.posexplode(labelled).alias("pos", "q"))
    return out.select("chart_id", F.col("pos").cast("long").alias("pos"), "q.question", F.col("q.type").alias("qtype"))


@register("prj32_override_pairs", f"""
with items as (select doc_id, case doc_id % 4 when 0 then ' ' || source || ' = ' || text || ' ' when 1 then source
                                              when 2 then '=' || lang else lang || '=a=b' end as item from documents),
cut as (select doc_id, contains(item, '=') and {strip_sql("split_part(item, '=', 1)")} <> ''
               and {strip_sql("substr(item, strpos(item, '=') + 1)")} <> '' as ok,
               {strip_sql("split_part(item, '=', 1)")} as a, {strip_sql("substr(item, strpos(item, '=') + 1)")} as b from items)
select doc_id, case when ok then a end as raw, case when ok then b end as renamed, ok from cut""")
def override_pairs(spark, sf):
    quarter = F.col("doc_id") % 4
    item = (
        F.when(quarter == 0, F.concat(F.lit(" "), "source", F.lit(" = "), "text", F.lit(" ")))
        .when(quarter == 1, F.col("source"))
        .when(quarter == 2, F.concat(F.lit("="), "lang"))
        .otherwise(F.concat("lang", F.lit("=a=b")))
    )
    return v.table(spark, sf, "documents").select("doc_id", F.inline(F.array(tx.override_pair(item))))


@register("prj33_results_with_model", """
select event_id, event_type as model, event_id % 1100 as chart_id, value from events""")
def results_with_model(spark, sf):
    return v.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("model"), (F.col("event_id") % 1100).alias("chart_id"), "value"
    )


@register("prj34_training_pairs", """
select cast(doc_id as varchar) as id, case when doc_id % 5 > 0 then 'images/' || doc_id || '_it0.png' end as image, text as description
from documents""")
def training_pairs(spark, sf):
    return v.records_v(spark, sf).select(
        "id", im.first_image(F.col("images"))["path"].alias("image"), F.col("graph.full_description").alias("description")
    )


@register("prj35_feature_schema", """
with n as (select count(c_custkey) as a, count(c_name) as b, count(c_nationkey) as c, count(c_acctbal) as d, count(c_mktsegment) as e from customer)
select 0 as pos, 'c_custkey' as name, 'bigint' as data_type, false as is_target, a as n_values from n
union all select 1, 'c_name', 'string', false, b from n
union all select 2, 'c_nationkey', 'int', false, c from n
union all select 3, 'c_acctbal', 'double', false, d from n
union all select 4, 'c_mktsegment', 'string', true, e from n""")
def feature_schema(spark, sf):
    return cols.feature_schema(v.table(spark, sf, "customer"), target="c_mktsegment")


@register("prj36_hue_and_marks", v.ctes(v.RESULTS) + """
select row_id, cast(floor(k / 100.0 * 120) as integer) as hue, case when coalesce(correct, false) then '✓' else '✗' end as mark,
       left(model || '-' || row_id, 8) as short_id
from results_v""")
def hue_and_marks(spark, sf):
    return v.results_v(spark, sf).select(
        "row_id", tx.accuracy_hue(F.col("k") / F.lit(100.0)).alias("hue"), tx.answer_mark(F.col("correct")).alias("mark"),
        tx.short_id(F.concat("model", F.lit("-"), F.col("row_id").cast("string"))).alias("short_id"),
    )


@register("prj3_iteration", v.ctes(v.IMAGES) + """
select chart_id, pos, coalesce(try_cast(regexp_extract(path, '_it([0-9]+)(\\.[^./]*)?$', 1) as bigint), 0) as iteration,
       coalesce(try_cast(regexp_extract(replace(path, '_it', '.it'), '_it([0-9]+)(\\.[^./]*)?$', 1) as bigint), 0) as none
from images_v""")
def iteration(spark, sf):
    return v.images_v(spark, sf).select(
        "chart_id", "pos", im.iteration(F.col("path")).alias("iteration"),
        im.iteration(F.replace(F.col("path"), F.lit("_it"), F.lit(".it"))).alias("none"),
    )


@register("prj4_final_image_quality", v.ctes(v.REC_IMAGES) + """, last as (
  select doc_id, max(pos) as n from rec_images group by 1)
select d.doc_id, 'images/' || d.doc_id || '_it' || l.n || '.png' as final_image,
       case when l.n >= 3 and (d.doc_id + l.n) % 3 <> 0 then 'bad' else 'good' end as quality,
       case when l.n is null then 'images/' else 'images/' || d.doc_id || '_it' || l.n || '.png' end as bundle_path,
       case when l.n is not null then 'images/' || d.doc_id || '_it0.png' end as first_image,
       'images/' || d.doc_id || '_it' || l.n || '.png' as last_image
from documents d left join last l on d.doc_id = l.doc_id""")
def final_image_quality(spark, sf):
    images = F.col("images")
    return v.records_v(spark, sf).select(
        F.col("id").cast("long").alias("doc_id"),
        im.final_image(images)["path"].alias("final_image"),
        im.quality(images).alias("quality"),
        im.bundle_path(im.final_image(images)["path"]).alias("bundle_path"),
        im.first_image(images)["path"].alias("first_image"),
        im.last_image(images)["path"].alias("last_image"),
    )


@register("prj5_feedback_text", f"""
with lists as (select conv_id, turn, list_filter([{strip_sql("' ' || role")}, {strip_sql("case when turn % 2 = 0 then '  ' else text end")}], lambda x: x <> '') as kept
               from conversations)
select conv_id, turn, array_to_string(kept, ' ') as feedback,
       array_to_string(list_transform(kept, lambda x: '- ' || x), chr(10)) as bullets from lists""")
def feedback_text(spark, sf):
    items = F.array(F.concat(F.lit(" "), "role"), F.when(F.col("turn") % 2 == 0, "  ").otherwise(F.col("text")))
    return v.table(spark, sf, "conversations").select(
        "conv_id", "turn", im.feedback_list(items).alias("feedback"), im.feedback_bullets(items).alias("bullets")
    )


@register("prj11_image_paths", v.ctes(v.REC_IMAGES) + """
select doc_id, pos, 'images/' || split_part(path, '/', -1) as bundled,
       case when starts_with(path, 'images/1') then substr(path, 9) else path end as unprefixed,
       case when pos % 2 = 0 then 'images/' || doc_id || '_it' || pos || '.jpg' else path end as mapped
from rec_images""")
def image_paths(spark, sf):
    records = v.records_v(spark, sf)
    images = F.col("images")
    even = F.filter(images, lambda x, i: i % 2 == 0)
    known = F.map_from_arrays(
        F.transform(even, lambda x: x["path"]), F.transform(even, lambda x: F.replace(x["path"], F.lit(".png"), F.lit(".jpg")))
    )
    zipped = F.arrays_zip(
        F.transform(images, lambda x: im.bundle_path(x["path"])).alias("bundled"),
        F.transform(im.without_prefix(images, "images/1"), lambda x: x["path"]).alias("unprefixed"),
        F.transform(im.mapped_paths(images, known), lambda x: x["path"]).alias("mapped"),
    )
    out = records.select(F.col("id").cast("long").alias("doc_id"), F.posexplode(zipped).alias("pos", "x"))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "x.*")


@register("prj28_chosen_code", """
select cast(doc_id as varchar) as id,
       case when doc_id % 5 > 0 then 'df["' || source || '"].plot("v' || (doc_id % 5 - 1) || '")' else 'df[''' || lang || '''].plot()' end as code,
       'df[''' || lang || '''].plot()' as graph_code
from documents""")
def chosen_code(spark, sf):
    graph_code = F.col("graph.code")
    return v.records_v(spark, sf).select(
        "id", im.chosen_code(F.col("images"), graph_code).alias("code"),
        im.chosen_code(F.col("images"), graph_code, "graph").alias("graph_code"),
    )


@register("prj1_evaluation_rows", v.ctes(v.REC_QUESTIONS) + """
select cast(chart_id as varchar) as graph_id, dataset_id, pos, question, answer, answer_basis, qtype,
       case when chart_id % 5 > 0 then 'images/' || chart_id || '_it' || (chart_id % 5 - 1) || '.png' end as image,
       text as dataset_description
from rec_questions""")
def evaluation_rows(spark, sf):
    rows = cols.evaluation_rows(v.records_v(spark, sf))
    return rows.select("graph_id", "dataset_id", F.col("pos").cast("long").alias("pos"), "question.question", "question.answer",
                       "question.answer_basis", F.col("question.type").alias("qtype"), "image", "dataset_description")
