"""Text, title, name, date and nested-field functions, and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import filters, split
from ..plans import fixtures as fx
from . import query

# White space of the functions module, as an RE2 class.
SP = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORDCH = r"\p{L}\p{M}\p{Nd}\p{Pc}"
STOP = ("the", "and", "of", "to", "in", "is", "that", "with", "for", "le", "la", "de", "der", "die", "el")


def squeeze_sql(c: str) -> str:
    return f"regexp_replace({c}, '{SP}+', ' ', 'g')"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SP}+'), lambda w: w <> '')"


def tokens_sql(c: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, '[{WORDCH}]+|[^{WORDCH}\\s\\x0b\\x1c-\\x1f\\x85\\xa0]')) AS INTEGER)"


def _speech_sql(c: str, forms) -> str:
    out = squeeze_sql(c)
    for form in forms:
        out = f"replace({out}, '{form}', '{fixed.ADDRESS}')"
    for opening in (r"^Mr\. Speaker, ", r"^I yield.*?\. *", r"^Mr\. Speaker, "):
        out = f"regexp_replace({out}, '{opening}', '')"
    return out


SALUTES = (
    "Mr. President, ", "Madam Chairman, ", "Mr. Speaker, I yield to the gentleman. Mr. Speaker, ",
    "Madam Chairwoman, thank you. ", "Mr.  Chairman,  ",
)
_LED = fx._case("doc_id % 5", SALUTES) + " || text"


def _salute():
    return F.element_at(F.array(*[F.lit(s) for s in SALUTES]), (F.col("doc_id") % 5 + 1).cast("int"))


@query("F1", f"""SELECT doc_id, md5({_speech_sql(_LED, fixed.ADDRESS_FORMS)}) AS speech,
   md5({_speech_sql(_LED, sorted(fixed.ADDRESS_FORMS, key=len, reverse=True))}) AS speech_fixed FROM documents""")
def clean_speeches(spark, sf):
    led = F.concat(_salute(), "text")
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(text.clean_speech(led)).alias("speech"),
        F.md5(text.clean_speech(led, fixed_order=True)).alias("speech_fixed"),
    )


def title_sql(source: str, title: str) -> str:
    """CTEs that normalise a title, step by step; the last one is ``std``."""
    led = " OR ".join(f"starts_with(t, '{p}')" for p in fixed.COMMA_PREFIXES)
    steps = [
        f"t0 AS (SELECT *, trim({squeeze_sql(f'lower({title})')}) AS t FROM {source})",
        f"t1 AS (SELECT * REPLACE (CASE WHEN ({led}) AND instr(t, ', ') > 0 "
        f"THEN substr(t, instr(t, ', ') + 2) ELSE t END AS t) FROM t0)",
        f"t2 AS (SELECT *, starts_with(t, '{fixed.TITLE_REJECT}') AS rejected FROM t1)",
    ]
    i = 2
    for p in fixed.PLAIN_PREFIXES:
        steps.append(
            f"t{i + 1} AS (SELECT * REPLACE (CASE WHEN starts_with(t, '{p}') THEN substr(t, {len(p) + 1}) "
            f"ELSE t END AS t) FROM t{i})"
        )
        i += 1
    steps.append(
        f"t{i + 1} AS (SELECT * REPLACE (regexp_replace(CASE WHEN contains(t, '--') "
        f"THEN trim(split_part(t, '--', 1)) ELSE t END, '[.,;]$', '') AS t) FROM t{i})"
    )
    i += 1
    for e in fixed.TITLE_ENDINGS:
        steps.append(
            f"t{i + 1} AS (SELECT * REPLACE (CASE WHEN ends_with(t, '{e}') THEN left(t, length(t) - {len(e)}) "
            f"ELSE t END AS t) FROM t{i})"
        )
        i += 1
    year = f"regexp_replace(t, ', \\d{{4}}$', '')"
    year = f"regexp_replace({year}, 'act of \\d{{4}}$', 'act')"
    year = f"regexp_replace({year}, 'act of$', 'act')"
    plain = f"regexp_replace({year}, '[^A-Za-z0-9\\s]+', '', 'g')"
    steps.append(
        f"std AS (SELECT * EXCLUDE (t, rejected), CASE WHEN NOT rejected THEN nullif({plain}, '') END "
        f"AS standardized_title FROM t{i})"
    )
    return ",\n".join(steps)


@query("F2", f"WITH {fx.TITLED_SQL}, {title_sql('titled', 'doc_title')} SELECT doc_id, doc_title, standardized_title FROM std")
def standard_titles(spark, sf):
    return fx.titled_documents(spark, sf).select(
        "doc_id", "doc_title", text.standardize_title("doc_title").alias("standardized_title")
    )


def _norm_sql(c: str, urls: bool, digits: bool) -> str:
    out = f"lower(coalesce({c}, ''))"
    if urls:
        out = f"regexp_replace({out}, 'http[^\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+', '', 'g')"
    out = f"regexp_replace({out}, '[^{WORDCH}\\s\\x0b\\x1c-\\x1f\\x85\\xa0]', ' ', 'g')"
    if digits:
        out = f"regexp_replace({out}, '\\p{{Nd}}+', ' ', 'g')"
    return f"trim({squeeze_sql(out)})"


NORM_SQL = _norm_sql("text", False, False)


@query("F3 F4 F5", f"""SELECT doc_id, md5({NORM_SQL}) AS plain, md5({_norm_sql("text", True, True)}) AS plain_no_urls,
   md5(array_to_string(list_filter({words_sql(NORM_SQL)}, lambda w: NOT list_contains({list(STOP)}, w)), ' ')) AS content
 FROM documents""")
def normalized_texts(spark, sf):
    plain = text.normalize_text("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(plain).alias("plain"),
        F.md5(text.normalize_text("text", urls=True, digits=True)).alias("plain_no_urls"),
        F.md5(text.remove_stopwords(plain, STOP)).alias("content"),
    )


def _html_sql() -> str:
    out = "regexp_replace(html, '(?is)<!--.*?-->', '<!>', 'g')"
    for tag in ("script", "style", "template"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '<!>', 'g')"
    out = f"regexp_replace({out}, '(?:<[!/?a-zA-Z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>)+', ' ', 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"regexp_replace(regexp_replace({out}, '^{SP}+', ''), '{SP}+$', '')"


@query("F6", f"SELECT page_id, {_html_sql()} AS page_text FROM pages")
def html_texts(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", text.strip_html("html").alias("page_text"))


@query("F7", """SELECT d.doc_id, md5(trim(d.text || ' ' || coalesce(i.text, ''))) AS combined
 FROM documents d LEFT JOIN benchmark i ON i.item_id = d.doc_id
 WHERE regexp_matches(d.text || ' ' || coalesce(i.text, ''), '\\S')""")
def combined_texts(spark, sf):
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("summary"))
    df = fx.table(spark, sf, "documents").select("doc_id", "text").join(items, "doc_id", "left")
    both = df.withColumn("both", text.combine_text("text", "summary")).where(text.strip("both") != "")
    return both.select("doc_id", F.md5(F.trim("both")).alias("combined"))


@query("F8 F22", """SELECT s_suppkey, upper(split_part(n, ',', 1)) AS lastname,
   trim(split_part(n, ',', 1)) AS lastname_as_written, trim('..' || s_name || '.', '.') AS trimmed
 FROM (SELECT *, 'McName' || s_name || ', Ann' AS n FROM supplier)""")
def roster_lastnames(spark, sf):
    name = F.concat(F.lit("McName"), "s_name", F.lit(", Ann"))
    return fx.table(spark, sf, "supplier").select(
        "s_suppkey",
        text.roster_lastname(name).alias("lastname"),
        text.roster_lastname(name, upper=False).alias("lastname_as_written"),
        text.trim_chars(F.concat(F.lit(".."), "s_name", F.lit("."))).alias("trimmed"),
    )


@query("F9 F10 F11", f"""WITH {fx.PEOPLE_SQL}, p AS (
  SELECT *, trim(CASE WHEN instr(speaker, '.') > 0 THEN substr(speaker, instr(speaker, '.') + 1) ELSE speaker END) AS name
  FROM speakers)
 SELECT speaker_id, trim(split_part(name, ' of ', 1)) AS lastname,
   CASE WHEN contains(name, ' of ') THEN trim(split_part(name, ' of ', 2)) END AS state,
   name AS after_salutation,
   substr(speaker, instr(speaker, ' ') + 1) AS no_salutation,
   upper(left(replace(split_part(name, ' of ', 1), '_', ''), 1)) || lower(substr(replace(split_part(name, ' of ', 1), '_', ''), 2)) || ', A' AS shown
 FROM p""")
def parsed_speakers(spark, sf):
    df = fx.speakers(spark, sf)
    parsed = text.parse_speaker("speaker")
    return df.select(
        "speaker_id",
        parsed["lastname"].alias("lastname"),
        parsed["state"].alias("state"),
        text.after_salutation("speaker").alias("after_salutation"),
        text.remove_salutation("speaker").alias("no_salutation"),
        text.display_name(F.concat(F.replace(parsed["lastname"], F.lit("_"), F.lit("")), F.lit(",a"))).alias("shown"),
    )


MARKED = f"""regexp_replace(regexp_replace(regexp_replace(text, '^{SP}+', ''), '{SP}+$', ''),
   '([.!?]){SP}+', '\\1' || chr(1), 'g')"""
SENTENCES_SQL = f"list_filter(string_split({MARKED}, chr(1)), lambda s: s <> '')"


@query("F12 F13 F14", f"""SELECT doc_id, CAST(len({words_sql("text")}) AS INTEGER) AS words,
   CAST(len({SENTENCES_SQL}) AS INTEGER) AS sentences, md5(array_to_string({SENTENCES_SQL}, '|')) AS sentences_hash,
   {tokens_sql("text")} AS tokens, {tokens_sql("text")} + 2 AS tokens_special FROM documents""")
def text_measures(spark, sf):
    found = text.sentences("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        text.word_count("text").alias("words"),
        F.size(found).alias("sentences"),
        F.md5(F.array_join(found, "|")).alias("sentences_hash"),
        text.token_count("text").alias("tokens"),
        text.token_count("text", special=2).alias("tokens_special"),
    )


def _targeted(spark, sf):
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("summary"))
    return fx.titled_documents(spark, sf).join(items, "doc_id", "left").withColumnRenamed("doc_title", "target")


TARGETED_SQL = f"{fx.TITLED_SQL}, targeted AS (SELECT d.* RENAME (doc_title AS target), b.text AS summary FROM titled d LEFT JOIN benchmark b ON b.item_id = d.doc_id)"
COMBINED = f"""({tokens_sql("document")} + 2 + 2 + {tokens_sql("target")} + {tokens_sql("coalesce(summary, '')")} + 3)"""


@query("F15 X2 P12", f"""WITH {TARGETED_SQL} SELECT doc_id, {COMBINED} AS combined,
   {COMBINED} > 512 OR {tokens_sql("document")} + 2 > 384 AS split, {COMBINED} > 512 AS split_training,
   md5('text: ' || document || ' target: ' || target) AS composed,
   md5('text: ' || document || ' targets: ' || target || ', ' || policy_area || ', ' || speaker) AS composed_many
 FROM targeted""")
def split_decisions(spark, sf):
    df = _targeted(spark, sf)
    names = ("document", "target", "summary")
    return df.select(
        "doc_id",
        text.combined_length(*names).alias("combined"),
        split.needs_split(*names).alias("split"),
        split.needs_split(*names, training=True).alias("split_training"),
        F.md5(text.compose_input("document", "target")).alias("composed"),
        F.md5(text.compose_input("document", "target", "policy_area", "speaker")).alias("composed_many"),
    )


# Units of a document in order: sentences, or the words of a sentence over the limit.
_UNITS_SQL = f"""{TARGETED_SQL},
 sents AS (SELECT doc_id, document, target, summary, unnest({SENTENCES_SQL.replace("text", "document")}) AS body,
             generate_subscripts({SENTENCES_SQL.replace("text", "document")}, 1) AS s FROM targeted
           WHERE {tokens_sql("document")} + 2 > 384),
 sized AS (SELECT doc_id, s, body, {tokens_sql("body")} AS size FROM sents),
 units AS (
   SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, w) AS u, body, size, kind FROM (
     SELECT doc_id, s, 0 AS w, body, size, 0 AS kind FROM sized WHERE size <= 384
     UNION ALL
     SELECT doc_id, s, w, body, {tokens_sql("body")}, CASE WHEN w = 1 THEN 2 ELSE 1 END FROM (
       SELECT doc_id, s, unnest({words_sql("body")}) AS body,
              generate_subscripts({words_sql("body")}, 1) AS w FROM sized WHERE size > 384)))"""

# Packing, unit by unit. A chunk is known by its parts: the units it opens with and takes up.
_PACK_SQL = f"""WITH RECURSIVE {_UNITS_SQL},
 packed AS (
   SELECT doc_id, 0::BIGINT AS u, 1 AS chunk, '' AS added, 0 AS size, '' AS last, 0 AS last_size, true AS empty FROM
     (SELECT DISTINCT doc_id FROM units)
   UNION ALL
   SELECT p.doc_id, n.u,
     CASE WHEN n.kind = 2 THEN CASE WHEN p.empty THEN p.chunk ELSE p.chunk + 1 END
          WHEN p.size + n.size + 1 <= 384 OR p.empty THEN p.chunk ELSE p.chunk + 1 END,
     CASE WHEN n.kind = 2 OR p.size + n.size + 1 <= 384 THEN n.body
          WHEN n.kind = 0 AND p.last <> '' AND p.last_size <= 50 THEN p.last || ' ' || n.body ELSE n.body END,
     CASE WHEN n.kind = 2 THEN CASE WHEN n.size + 1 <= 384 THEN n.size + 1 ELSE n.size END
          WHEN p.size + n.size + 1 <= 384 THEN p.size + n.size + 1
          WHEN n.kind = 0 AND p.last <> '' AND p.last_size <= 50 THEN p.last_size + n.size + 1 ELSE n.size END,
     CASE WHEN n.kind = 0 THEN n.body ELSE p.last END, CASE WHEN n.kind = 0 THEN n.size ELSE p.last_size END, false
   FROM packed p JOIN units n ON n.doc_id = p.doc_id AND n.u = p.u + 1),
 cut AS (SELECT doc_id, chunk, string_agg(added, ' ' ORDER BY u) AS document FROM packed WHERE u > 0 GROUP BY ALL),
 chunks AS (
   SELECT doc_id, CAST(chunk AS INTEGER) AS document_chunk, document,
          CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS document_chunks_total FROM cut
   UNION ALL
   SELECT doc_id, 1, document, 1 FROM targeted WHERE doc_id NOT IN (SELECT doc_id FROM units))
 SELECT doc_id, document_chunk, document_chunks_total, md5(document) AS document FROM chunks"""


@query("X1 N4", _PACK_SQL)
def document_chunks(spark, sf):
    out = split.split_documents(_targeted(spark, sf))
    return out.select(
        "doc_id", "document_chunk", "document_chunks_total", F.md5("document").alias("document")
    )


@query("F16 F23", """SELECT o_orderkey, strftime(coalesce(TRY_CAST(d AS DATE), DATE '1900-01-01'), '%Y-%m-%d') AS day,
   TRY_CAST(TRY_CAST(n AS DOUBLE) AS DOUBLE) AS number, CAST(o_orderkey AS VARCHAR) AS id
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a'
     ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
   CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE CAST(o_totalprice AS VARCHAR) END AS n FROM orders)""")
def parsed_dates(spark, sf):
    key = F.col("o_orderkey")
    day = F.when(key % 3 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    number = F.when(key % 4 == 0, "none").otherwise(F.col("o_totalprice").cast("string"))
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format(text.parse_date(day, fixed.EPOCH), "yyyy-MM-dd").alias("day"),
        text.to_number(number).alias("number"),
        key.cast("string").alias("id"),
    )


@query("F17 F20", """WITH n AS (SELECT l_orderkey AS doc_id, min(p_type) AS policy_area,
     list_sort(list_distinct(list(p_brand))) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
 SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE array_to_string(names, ',') END AS names,
   CASE WHEN doc_id % 10 = 0 THEN NULL ELSE policy_area || '_' || names[1] END AS label FROM n""")
def parsed_names(spark, sf):
    """Names out of JSON lists, a tenth of which do not parse."""
    brands = fx.chunk_scores(spark, sf).groupBy(F.col("document_id").alias("doc_id")).agg(
        F.min("policy_area").alias("policy_area"),
        F.to_json(F.transform(F.array_sort(F.collect_set("subtopic_1")), lambda b: F.struct(b.alias("name")))).alias("js"),
    )
    broken = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("[{oops "), "js")).otherwise(F.col("js"))
    names = text.names_from_json(broken)
    return brands.select(
        "doc_id",
        F.array_join(names, ",").alias("names"),
        text.label_key("policy_area", F.get(names, F.lit(0))).alias("label"),
    )


@query("F18", """SELECT o_orderkey AS bill, o_orderpriority AS committee, strftime(o_orderdate, '%Y-%m-%d') AS latest_activity,
   CASE WHEN o_orderkey % 2 = 0 THEN 'first ' || strftime(o_orderdate - INTERVAL 5 DAY, '%Y-%m-%d') ELSE '' END AS subcommittees
 FROM orders""")
def committee_activities(spark, sf):
    """Nested committees of each bill, and the latest activity of each."""
    day = F.to_date("o_orderdate")

    def acts(*days):
        return F.array(*[F.struct(F.date_format(d, "yyyy-MM-dd").alias("date")) for d in days])

    none = F.lit(None).cast("date")
    earlier = F.when(F.col("o_orderkey") % 2 == 0, F.date_sub(day, 5))
    subs = F.array(
        F.struct(F.lit("first").alias("name"), acts(F.date_sub(earlier, 30), earlier).alias("activities")),
        F.struct(F.lit("second").alias("name"), acts(none, none).alias("activities")),
    )
    committees = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("bill"),
        F.array(
            F.struct(
                F.col("o_orderpriority").alias("name"),
                acts(F.date_sub(day, 400), day, none).alias("activities"),
                subs.alias("subcommittees"),
            )
        ).alias("committees"),
    )
    c = F.get(text.committee_activity("committees"), F.lit(0))
    found = F.transform(
        c["subcommittees"],
        lambda s: F.concat_ws(" ", s["name"], F.date_format(s["latest_activity"], "yyyy-MM-dd")),
    )
    return committees.select(
        "bill",
        c["name"].alias("committee"),
        F.date_format(c["latest_activity"], "yyyy-MM-dd").alias("latest_activity"),
        F.array_join(found, ";").alias("subcommittees"),
    )


@query("F21 N6", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE source || '_' || lang || '_' ||
   CAST(doc_id AS VARCHAR) END AS document_id, md5('42' || chr(1) || CAST(doc_id AS VARCHAR)) AS row_id FROM documents""")
def document_ids(spark, sf):
    df = fx.table(spark, sf, "documents").select(
        "doc_id", "source", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("document_id")
    )
    df = filters.with_row_id(filters.ensure_doc_id(df, ["source", "lang", "doc_id"]), ["doc_id"])
    return df.select("doc_id", "document_id", "row_id")
