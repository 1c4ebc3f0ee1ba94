"""All registered queries of the screening engine, and the SQL that each must agree with."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import json_values, passages
from millrace.functions import text as T
from millrace.operators import evaluation, html_parts, multisets, overlay, payloads, rules, similarity, sketches, temporal, turns, vector_index
from millrace.sources import tables
from millrace.sources.tables import load
from millrace.streaming import conversations, screens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sql_canonical(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({column}), '[{T.ZERO_WIDTH}]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ')"


def _sql_hits(column: str, which=rules.INJECTION) -> str:
    """A list of (rule_id, family, n, weight) of the rules that hit column."""
    text = _sql_canonical(f"coalesce({column}, '')")
    rows = ", ".join(
        f"{{'rule_id': '{r.rule_id}', 'family': '{r.family}', 'n': len(regexp_extract_all({text}, '{r.pattern}'))::INTEGER, 'weight': {r.weight}::DOUBLE}}" for r in which
    )
    return f"list_filter([{rows}], lambda hit_: hit_.n > 0)"


def _sql_score(hits: str) -> str:
    return f"coalesce(list_sum(list_transform({hits}, lambda hit_: hit_.weight)), 0)"


# sources and sinks


@_query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
def scan_filtered(spark, d):
    return load(spark, d, "documents").where("lang = 'en' AND n_chars > 1000").select("doc_id", "source", "n_chars")


@_query("SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark, d):
    return tables.through_json(load(spark, d, "conversations"))


@_query("SELECT doc_id, text, lang, source FROM documents")
def csv_round_trip(spark, d):
    return tables.through_csv(load(spark, d, "documents").select("doc_id", "text", "lang", "source"))


@_query("SELECT conv_id, turn, FALSE AS is_bad FROM conversations UNION ALL SELECT NULL, NULL, TRUE FROM range(3)")
def json_bad_records(spark, d):
    """Turns as JSON Lines with three broken lines among them, by a declared schema."""
    turns_ = load(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    broken = spark.createDataFrame([('{"conv_id": 1, "turn"',), ("no json at all",), ('{"conv_id": "one", "turn": {}}',)], "value string")
    path = tables.shared_folder(spark, "json-lines")
    turns_.unionByName(broken).write.text(path)
    read = tables.read_json(spark, path, "conv_id long, turn long, role string, text string")
    bad = F.col(tables.BAD).isNotNull()
    return read.select(F.when(~bad, F.col("conv_id")).alias("conv_id"), F.when(~bad, F.col("turn")).alias("turn"), bad.alias("is_bad"))


@_query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) FILTER (WHERE {x} IS NULL) AS n_null_text, min({k}) AS min_id, max({k}) AS max_id, "
        f"count(DISTINCT {k}) AS n_ids, sum(length({x}))::BIGINT AS n_chars FROM {t}"
        for t, (k, x) in tables.TEXTS.items()
    )
)
def dataset_card(spark, d):
    return tables.card(spark, d)


# normalisation


@_query(f"SELECT doc_id, md5({_sql_canonical('text')}) AS canonical_md5 FROM documents")
def canonical_text(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(T.canonical(F.col("text"))).alias("canonical_md5"))


@_query()
def overlay_nfkc(spark, d):
    both = overlay.conversations(load(spark, d, "conversations"))
    return both.select("conv_id", "turn", F.md5(T.nfkc("text")).alias("nfkc_md5"))


@_query(f"SELECT conv_id, turn, md5(translate({_sql_canonical('text')}, '{T.HOMOGLYPHS[0]}', '{T.HOMOGLYPHS[1]}')) AS folded_md5 FROM {overlay.CONVERSATIONS_SQL}")
def overlay_homoglyphs(spark, d):
    return overlay.conversations(load(spark, d, "conversations")).select("conv_id", "turn", F.md5(T.unmasked(F.col("text"))).alias("folded_md5"))


def _sql_share(pattern: str) -> str:
    return f"round(len(regexp_extract_all(text, '{pattern}')) / greatest(length(text), 1), 6)"


@_query(
    f"""SELECT doc_id, length(text) AS n_characters, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens, len(string_split(text, chr(10)))::BIGINT AS n_lines,
    {_sql_share('[#*$%&|<>]')} AS symbol_share, {_sql_share('[A-Z]')} AS upper_share, {_sql_share('[0-9]')} AS digit_share FROM documents"""
)
def text_statistics(spark, d):
    return load(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in T.statistics(F.col("text")).items()])


@_query(
    """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY ALL)
    SELECT doc_id, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 4) AS entropy FROM n GROUP BY doc_id"""
)
def character_entropy(spark, d):
    return load(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.round(T.entropy(F.col("text")), 4).alias("entropy"))


_RUNS_SQL = f"""(WITH x AS (SELECT doc_id, 'hex' AS kind, unnest(regexp_extract_all(text, '{payloads.HEX}')) AS run FROM {overlay.DOCUMENTS_SQL}
    UNION ALL SELECT doc_id, 'base64', unnest(regexp_extract_all(text, '{payloads.BASE64}')) FROM {overlay.DOCUMENTS_SQL})
    SELECT doc_id, kind, run, length(run) AS n, count(*) AS times FROM x
    WHERE kind = 'hex' OR (regexp_matches(run, '[a-z]') AND regexp_matches(run, '[A-Z]') AND regexp_matches(run, '[0-9]') AND NOT regexp_matches(run, '^[0-9A-Fa-f]+$')) GROUP BY ALL)"""


@_query(f"SELECT * FROM {_RUNS_SQL}")
def encoded_payloads(spark, d):
    return payloads.runs(overlay.documents(load(spark, d, "documents")))


_DECODED_SQL = f"""(SELECT doc_id, kind, run, CASE WHEN kind = 'hex' AND n % 2 = 0 THEN try(from_hex(run)) WHEN kind = 'base64' AND n % 4 = 0 THEN try(from_base64(run)) END AS bytes FROM {_RUNS_SQL})"""


@_query(
    f"""WITH t AS (SELECT doc_id, kind, run, octet_length(bytes)::INTEGER AS n_bytes, try(decode(bytes)) AS text FROM {_DECODED_SQL})
    SELECT doc_id, kind, run, n_bytes, text IS NOT NULL AS is_text, len({_sql_hits('text')})::INTEGER AS n_rules FROM t"""
)
def decoded_payloads(spark, d):
    """Payloads decoded, and the rules run on what they say."""
    found = rules.with_hits(payloads.decoded(encoded_payloads(spark, d)), "text")
    return found.select("doc_id", "kind", "run", F.length("bytes").alias("n_bytes"), F.col("text").isNotNull().alias("is_text"), F.size("hits").alias("n_rules"))


# direct


def _users(spark, d):
    return overlay.conversations(load(spark, d, "conversations")).where("role = 'user'")


@_query(f"SELECT conv_id, turn, len({_sql_hits('text')})::INTEGER AS n_rules FROM {overlay.CONVERSATIONS_SQL} WHERE role = 'user'")
def overlay_rule_scan(spark, d):
    return rules.with_hits(_users(spark, d), "text").select("conv_id", "turn", F.size("hits").alias("n_rules"))


_HITS_SQL = f"SELECT conv_id, turn, unnest(h, recursive := true) FROM (SELECT conv_id, turn, unnest({_sql_hits('text')}) AS h FROM {overlay.CONVERSATIONS_SQL} WHERE role = 'user')"


@_query(_HITS_SQL)
def overlay_rule_hits(spark, d):
    return rules.exploded(rules.with_hits(_users(spark, d), "text"), ["conv_id", "turn"])


@_query(
    f"""WITH x AS (SELECT conv_id, {_sql_hits('text')} AS h FROM {overlay.CONVERSATIONS_SQL} WHERE role = 'user')
    SELECT conv_id, round(sum({_sql_score('h')}), 6) AS score, round(sum({_sql_score('h')}), 6) >= 0.7 AS flagged,
    array_to_string(list_sort(list_distinct(flatten(list(list_transform(h, lambda hit_: hit_.family))))), ',') AS families FROM x GROUP BY conv_id"""
)
def overlay_verdicts(spark, d):
    return rules.verdicts(rules.with_hits(_users(spark, d), "text"), ["conv_id"])


_MARKER = next(r.pattern for r in rules.INJECTION if r.rule_id == "role_marker")


@_query(f"SELECT conv_id, turn, role FROM {overlay.CONVERSATIONS_SQL} WHERE regexp_matches({_sql_canonical('text')}, '{_MARKER}')")
def overlay_role_markers(spark, d):
    return turns.spoofed(overlay.conversations(load(spark, d, "conversations")))


@_query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS w FROM documents)
    SELECT doc_id, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 6) END AS distinct_share FROM w"""
)
def repetition_ratio(spark, d):
    return load(spark, d, "documents").select("doc_id", T.repetition(F.col("text")).alias("distinct_share"))


@_query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text)")
def known_text_containment(spark, d):
    return similarity.contained(load(spark, d, "documents"), load(spark, d, "benchmark"))


def _sql_grams(table: str, key: str, n: int = 8) -> str:
    return f"""SELECT DISTINCT {key}, unnest(list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram
    FROM (SELECT {key}, regexp_extract_all(lower(text), '[^ \\t\\n\\r]+') AS w FROM {table}) WHERE len(w) >= {n}"""


@_query(f"SELECT doc_id, item_id, count(*) AS n_shared FROM ({_sql_grams('documents', 'doc_id')}) JOIN ({_sql_grams('benchmark', 'item_id')}) USING (gram) GROUP BY ALL")
def ngram_overlap(spark, d):
    return similarity.shared_ngrams(load(spark, d, "documents"), load(spark, d, "benchmark"))


@_query("SELECT md5(lower(text)) AS text_md5, count(*) AS n_docs, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, d):
    return similarity.copies(load(spark, d, "documents"))


@_query(
    """WITH RECURSIVE t AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents), r AS (SELECT x, min(doc_id) AS rep FROM t GROUP BY x),
    w AS (SELECT rep, regexp_extract_all(x, '[^ \\t\\n\\r]+') AS w FROM r),
    s AS (SELECT DISTINCT rep, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w),
    c AS (SELECT rep, count(*) AS n FROM s GROUP BY rep), p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.rep <> b.rep GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN c ca ON ca.rep = a JOIN c cb ON cb.rep = b WHERE k >= 0.8 * (ca.n + cb.n - k)),
    reach(a, b) AS (SELECT rep, rep FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), k AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a)
    SELECT doc_id, class_id FROM t JOIN r USING (x) JOIN k USING (rep)"""
)
def minhash_classes(spark, d):
    return similarity.near_copies(load(spark, d, "documents"))


@_query(
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
    v AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM u),
    p AS (SELECT q.vec_id AS query_id, a.vec_id, round(list_inner_product(a.v, q.v), 4) AS similarity FROM v a JOIN v q ON q.vec_id % 100 = 0 AND a.vec_id <> q.vec_id)
    SELECT query_id, vec_id, rank::INTEGER AS rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""
)
def embedding_neighbours(spark, d):
    return similarity.neighbours(load(spark, d, "embeddings"))


@_query()
def indexed_neighbours(spark, d):
    """As `embedding_neighbours`, by an index that looks through the nearest lists only; recall is tested.

    The tables' vectors point in all directions alike, which leaves an index little to go by: nine in ten of the
    nearest take three lists in five. In vectors that gather in clusters a tenth of the lists will do.
    """
    index = vector_index.built(load(spark, d, "embeddings"))
    return vector_index.searched(index, index.rows.where(F.col("vec_id") % 100 == 0), probes=max(1, -(-3 * len(index.centroids) // 5)))


# lines as multisets: what a source's documents have beyond those of another, copies counted

_LINES_SQL = "(SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE source {})"


def _lines(spark, d):
    docs = load(spark, d, "documents")
    first = docs.agg(F.min("source")).first()[0]
    return multisets.lines(docs.where(F.col("source") == first)), multisets.lines(docs.where(F.col("source") != first))


_FIRST_SQL, _OTHER_SQL = (_LINES_SQL.format(f"{op} (SELECT min(source) FROM documents)") for op in ("=", "<>"))


@_query(f"SELECT * FROM {_FIRST_SQL} EXCEPT ALL SELECT * FROM {_OTHER_SQL}")
def lines_surplus(spark, d):
    return multisets.surplus(*_lines(spark, d))


@_query(f"SELECT * FROM {_FIRST_SQL} INTERSECT ALL SELECT * FROM {_OTHER_SQL}")
def lines_common(spark, d):
    return multisets.common(*_lines(spark, d))


@_query(f"SELECT line, sum(a)::BIGINT AS n_a, sum(1 - a)::BIGINT AS n_b FROM (SELECT line, 1 AS a FROM {_FIRST_SQL} UNION ALL SELECT line, 0 FROM {_OTHER_SQL}) GROUP BY line")
def lines_balance(spark, d):
    return multisets.balance(*_lines(spark, d))


# passages, by table functions


@_query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 50) / 25))::INTEGER)) AS i FROM w WHERE len(w) > 0)
    SELECT doc_id, i::INTEGER AS passage_no, (i * 25)::INTEGER AS first_word, md5(array_to_string(w[i * 25 + 1:i * 25 + 50], ' ')) AS passage_md5 FROM p"""
)
def document_passages(spark, d):
    found = passages.of_documents(load(spark, d, "documents"), 50, 25)
    return found.select("doc_id", "passage_no", "first_word", F.md5("passage").alias("passage_md5"))


@_query(
    """WITH t AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER w AS k, first_value(turn) OVER f AS first_turn, list(role || ': ' || text) OVER f AS said
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn), f AS (PARTITION BY conv_id ORDER BY turn ROWS 2 PRECEDING))
    SELECT conv_id, first_turn, turn AS last_turn, md5(array_to_string(said, chr(10))) AS passage_md5 FROM t WHERE k >= 3 OR (n < 3 AND k = n)"""
)
def turn_passages(spark, d):
    found = passages.of_conversations(load(spark, d, "conversations"), 3)
    return found.select("conv_id", "first_turn", "last_turn", F.md5("passage").alias("passage_md5"))


# semi-structured values

#: Beside the table's own: text that is no JSON, null, another type, another field, none.
_PROPS = ((-1, "{broken"), (-2, None), (-3, '{"k": "7"}'), (-4, '{"other": {"k": 1}}'), (-5, "[1, 2]"), (-6, '{"k": 2.5, "x y": true}'))
_PROPS_SQL = ", ".join(f"({i}::BIGINT, {'NULL' if x is None else repr(x)})" for i, x in _PROPS)


@_query(
    f"""WITH e AS (SELECT event_id, props FROM events UNION ALL SELECT * FROM (VALUES {_PROPS_SQL}) v(event_id, props)), j AS (SELECT event_id, try_cast(props AS JSON) AS j FROM e)
    SELECT event_id, j IS NOT NULL AS is_json, try_cast(try_cast(j->>'$.k' AS DOUBLE) AS DECIMAL(18, 1))::DOUBLE AS k, try_cast(j->>'$."x y"' AS BOOLEAN) AS flag FROM j"""
)
def event_properties(spark, d):
    """Events' properties as VARIANT, read by path; text that is no JSON is null."""
    rows = load(spark, d, "events").select("event_id", "props").unionByName(spark.createDataFrame(list(_PROPS), "event_id long, props string"))
    v = rows.select("event_id", json_values.parsed(F.col("props")).alias("v"))
    read = lambda path, kind: json_values.value(F.col("v"), path, kind)
    return v.select("event_id", F.col("v").isNotNull().alias("is_json"), F.round(read("$.k", "double"), 1).alias("k"), read("$['x y']", "boolean").alias("flag"))


@_query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def event_fields(spark, d):
    """A column for each field that the events' properties have, by a schema inferred in one aggregate."""
    return json_values.flattened(load(spark, d, "events").select("event_id", json_values.parsed(F.col("props")).alias("v")), "v")


# sketches


@_query()
def word_sketches(spark, d):
    """Distinct and top words by source, and of all sources from the stored sketches of each; error bounds are tested."""
    by_source = tables.stored(sketches.sketched(sketches.words(load(spark, d, "documents"), "source"), "source"), "sketches")
    whole = sketches.merged(by_source).select(F.lit(None).cast("string").alias("source"), "*")
    return sketches.read(by_source.unionByName(whole))


# joins in time


@_query(
    """WITH k AS (SELECT DISTINCT event_type AS kind FROM events), o AS (SELECT user_id, kind, ts, max(event_id) AS earlier_id FROM events e JOIN k ON e.event_type <> k.kind GROUP BY ALL)
    SELECT e.event_id, o.earlier_id, epoch_us(e.ts) - epoch_us(o.ts) AS gap_us FROM events e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.event_type = o.kind AND e.ts > o.ts"""
)
def events_as_of(spark, d):
    """Each event with the user's last earlier event of another type."""
    events = load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    kinds = events.agg(F.collect_set("event_type")).first()[0]
    others = F.explode(F.array_except(F.array(*map(F.lit, sorted(kinds))), F.array("event_type")))
    right = events.select("user_id", others.alias("event_type"), "ts", F.col("event_id").alias("earlier_id"), F.col("ts").alias("earlier_ts"))
    met = temporal.as_of(events, right, ["user_id", "event_type"], "ts", ["earlier_id", "earlier_ts"], same_time=False)
    return met.select("event_id", "earlier_id", F.timestamp_diff("MICROSECOND", "earlier_ts", "ts").alias("gap_us"))


#: A window that is as long as the table, beside those of minutes.
_WINDOWS_SQL = """(SELECT event_id AS window_id, ts AS begun, ts + to_microseconds((value * 60000000)::BIGINT) AS ended FROM events WHERE event_type = 'error'
    UNION ALL SELECT -1, min(ts), max(ts) FROM events)"""


@_query(f"SELECT e.event_id, w.window_id FROM events e JOIN {_WINDOWS_SQL} w ON w.begun <= e.ts AND e.ts < w.ended WHERE e.event_type = 'purchase'")
def events_in_windows(spark, d):
    """Purchases within the windows that errors open, as many minutes long as their value says, or within the whole time."""
    events = load(spark, d, "events")
    ended = F.col("ts") + F.make_dt_interval(secs=F.round(F.col("value") * 60, 6).cast("decimal(18,6)"))
    windows = events.where("event_type = 'error'").select(F.col("event_id").alias("window_id"), F.col("ts").alias("begun"), ended.alias("ended"))
    whole = events.agg(F.lit(-1).cast("long").alias("window_id"), F.min("ts").alias("begun"), F.max("ts").alias("ended"))
    purchases = events.where("event_type = 'purchase'").select("event_id", "ts")
    return temporal.within(purchases, windows.unionByName(whole), "ts", "begun", "ended").select("event_id", "window_id")


@_query(
    """SELECT e.event_id, s.event_id AS signup_id FROM events e JOIN events s ON e.user_id = s.user_id AND s.event_type = 'signup' AND e.event_type <> 'signup' AND s.ts <= e.ts AND e.ts < s.ts + INTERVAL 1 DAY"""
)
def events_after_signup(spark, d):
    """Events within a day of a signup of their user."""
    events = load(spark, d, "events")
    days = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("begun"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ended"))
    others = events.where("event_type <> 'signup'").select("user_id", "event_id", "ts")
    return temporal.within(others, days, "ts", "begun", "ended", ["user_id"]).select("event_id", "signup_id")


# indirect

_VISIBLE_SQL = "html"
for _p in (html_parts.SCRIPT, html_parts.STYLE, html_parts.COMMENT, html_parts.TITLE):
    _VISIBLE_SQL = f"regexp_replace({_VISIBLE_SQL}, '{_p}', ' ', 'g')"
_VISIBLE_SQL = f"trim(regexp_replace(regexp_replace({_VISIBLE_SQL}, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ')"


def _sql_parts(source: str) -> str:
    every = {"title": html_parts.TITLE, "comment": html_parts.COMMENT, "script": html_parts.SCRIPT, "style": html_parts.STYLE, "href": html_parts.HREF}
    rows = [f"{{'part': 'visible', 'text': {_VISIBLE_SQL}}}", *(f"{{'part': '{k}', 'text': array_to_string(regexp_extract_all(html, '{p}', 1), ' ')}}" for k, p in every.items())]
    return f"(SELECT page_id, p.part AS part, p.text AS text FROM (SELECT page_id, unnest([{', '.join(rows)}]) AS p FROM {source}) WHERE p.text <> '')"


@_query(f"SELECT page_id, part, md5(text) AS text_md5, length(text) AS n FROM {_sql_parts('pages')}")
def page_parts(spark, d):
    return html_parts.by_part(load(spark, d, "pages")).select("page_id", "part", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


@_query(
    f"""SELECT page_id, round(coalesce(sum(length(text)) FILTER (WHERE part IN ('comment', 'script', 'style')), 0) / nullif(coalesce(sum(length(text)) FILTER (WHERE part = 'visible'), 0), 0), 6) AS hidden_ratio
    FROM {_sql_parts('pages')} GROUP BY page_id"""
)
def hidden_ratio(spark, d):
    size = lambda *names: F.coalesce(F.sum(F.when(F.col("part").isin(*names), F.length("text"))), F.lit(0))
    return html_parts.by_part(load(spark, d, "pages")).groupBy("page_id").agg(F.round(F.try_divide(size("comment", "script", "style"), size("visible")), 6).alias("hidden_ratio"))


@_query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS n_pages, sum(length(html))::BIGINT AS n_chars, max(length(html)) AS longest FROM pages GROUP BY 1")
def host_roll_up(spark, d):
    pages = load(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.length("html").cast("long").alias("n"))
    return pages.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_chars"), F.max("n").alias("longest"))


_WEIGHT_SQL = "CASE part " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in html_parts.WEIGHTS.items()) + " END"


@_query(
    f"""SELECT page_id, round(sum(({_WEIGHT_SQL}) * {_sql_score(_sql_hits('text'))}), 6) AS score, sum(len({_sql_hits('text')}))::BIGINT AS n_rules
    FROM {_sql_parts(overlay.PAGES_SQL)} GROUP BY page_id"""
)
def overlay_page_scan(spark, d):
    parts = rules.with_hits(html_parts.by_part(overlay.pages(load(spark, d, "pages"))), "text")
    weight = F.create_map(*[F.lit(x) for kv in html_parts.WEIGHTS.items() for x in kv])[F.col("part")]
    return parts.groupBy("page_id").agg(F.round(F.sum(weight * rules.score()), 6).alias("score"), F.sum(F.size("hits")).alias("n_rules"))


def _abuse(spark, d, docs=None):
    return rules.with_hits(load(spark, d, "documents") if docs is None else docs, "text", rules.ABUSE)


_ABUSE_SQL = f"(SELECT doc_id, source, lang, len({_sql_hits('text', rules.ABUSE)}) > 0 AS hit, {_sql_score(_sql_hits('text', rules.ABUSE))} AS score, coalesce(list_sum(list_transform({_sql_hits('text', rules.ABUSE)}, lambda hit_: hit_.n)), 0) AS n FROM documents)"


@_query(
    f"SELECT source, lang, grouping(source, lang)::BIGINT AS level, count(*) AS n_docs, count(*) FILTER (WHERE hit) AS n_hit, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate FROM {_ABUSE_SQL} GROUP BY CUBE (source, lang)"
)
def flag_rate_cube(spark, d):
    hit = F.size("hits") > 0
    grouped = _abuse(spark, d).withColumn("hit", hit).cube("source", "lang")
    return grouped.agg(F.grouping_id("source", "lang").alias("level"), F.count("*").alias("n_docs"), F.count_if("hit").alias("n_hit"), F.round(F.count_if("hit") / F.count("*"), 6).alias("hit_rate"))


@_query(f"SELECT d.doc_id FROM documents d ANTI JOIN (SELECT doc_id FROM {_ABUSE_SQL} WHERE hit) h USING (doc_id)")
def documents_without_hit(spark, d):
    return load(spark, d, "documents").select("doc_id").join(_abuse(spark, d).where(F.size("hits") > 0).select("doc_id"), "doc_id", "left_anti")


@_query(f"SELECT d.doc_id, d.lang FROM documents d SEMI JOIN (SELECT doc_id FROM {_ABUSE_SQL} WHERE hit) h USING (doc_id)")
def documents_with_hit(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang").join(_abuse(spark, d).where(F.size("hits") > 0).select("doc_id"), "doc_id", "left_semi")


# multi-turn


@_query("SELECT conv_id, turn, role, length(text) - lag(length(text)) OVER (PARTITION BY conv_id, role ORDER BY turn) AS change FROM conversations")
def turn_change(spark, d):
    return turns.change_by_role(load(spark, d, "conversations"))


@_query(
    f"""WITH x AS (SELECT conv_id, turn, {_sql_score(_sql_hits('text'))} AS s FROM {overlay.CONVERSATIONS_SQL})
    SELECT conv_id, turn, round(s, 6) AS turn_score, round(sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 6) AS running_score FROM x"""
)
def overlay_running_score(spark, d):
    return turns.running_score(overlay.conversations(load(spark, d, "conversations")))


@_query(
    f"""WITH u AS (SELECT conv_id, turn, text, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS 2 PRECEDING), ' ') AS joined FROM {overlay.CONVERSATIONS_SQL} WHERE role = 'user'),
    x AS (SELECT conv_id, turn, len({_sql_hits('text')})::BIGINT AS n_alone, len({_sql_hits('joined')})::BIGINT AS n_together FROM u) SELECT * FROM x WHERE n_together > n_alone"""
)
def overlay_split_payload(spark, d):
    return turns.split_payload(overlay.conversations(load(spark, d, "conversations")))


@_query(
    f"""WITH x AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {overlay.CONVERSATIONS_SQL})
    SELECT * FROM x WHERE role = before OR (role = 'system' AND turn > 0) OR (before IS NULL AND role = 'assistant')"""
)
def overlay_role_order(spark, d):
    return turns.order_violations(overlay.conversations(load(spark, d, "conversations")))


@_query("SELECT conv_id, count(*) AS n_turns, round(CASE WHEN count(*) > 1 THEN regr_slope(length(text), turn) END, 4) AS slope FROM conversations GROUP BY conv_id")
def turn_length_trend(spark, d):
    return turns.length_trend(load(spark, d, "conversations"))


@_query(f"SELECT conv_id, min(turn) AS first_turn, arg_min(role, turn) AS role FROM {overlay.CONVERSATIONS_SQL} WHERE {_sql_score(_sql_hits('text'))} >= 0.7 GROUP BY conv_id")
def overlay_first_flagged(spark, d):
    return turns.first_flagged(overlay.conversations(load(spark, d, "conversations")))


@_query(
    f"""WITH x AS (SELECT conv_id, {_sql_score(_sql_hits('text'))} AS s FROM {overlay.CONVERSATIONS_SQL})
    SELECT conv_id, round(max(s), 6) AS top_score, bool_or(s >= 0.7) AS flagged, count(*) AS n_turns FROM x GROUP BY conv_id"""
)
def overlay_conversation_verdict(spark, d):
    return turns.verdict(overlay.conversations(load(spark, d, "conversations")))


# evaluation, with `toxic` as a stand-in label


def _judged(spark, d):
    labels = load(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = F.aggregate("hits", F.lit(0), lambda a, h: a + h["n"])
    # texts without a label aren't screened, as long as the labels' ids can be sent to all tasks
    docs = similarity.having(load(spark, d, "documents"), labels, "doc_id")
    return _abuse(spark, d, docs).select("doc_id", (F.size("hits") > 0).alias("hit"), n.alias("n"), F.length("text").cast("long").alias("n_chars")).join(labels, "doc_id")


_JUDGED_SQL = f"(SELECT a.doc_id, a.hit, a.n, toxic FROM {_ABUSE_SQL} a JOIN labels USING (doc_id))"
_CELLS_SQL = "count(*) FILTER (WHERE hit AND toxic = 1) AS tp, count(*) FILTER (WHERE hit AND toxic = 0) AS fp, count(*) FILTER (WHERE NOT hit AND toxic = 1) AS fn, count(*) FILTER (WHERE NOT hit AND toxic = 0) AS tn"


@_query(f"SELECT {_CELLS_SQL} FROM {_JUDGED_SQL}")
def confusion_matrix(spark, d):
    return evaluation.confusion(_judged(spark, d), F.col("hit"), F.col("toxic") == 1)


@_query(
    f"""WITH c AS (SELECT {_CELLS_SQL} FROM {_JUDGED_SQL}) SELECT *, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision_,
    round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"""
)
def screen_eval(spark, d):
    return evaluation.rates(confusion_matrix(spark, d))


@_query(
    f"""WITH r AS (SELECT toxic, row_number() OVER (ORDER BY n DESC, doc_id) AS rk FROM {_JUDGED_SQL}), k AS (SELECT unnest([10, 50, 100, 500])::INTEGER AS k),
    p AS (SELECT count(*) FILTER (WHERE toxic = 1) AS positives FROM r)
    SELECT k, count(*) FILTER (WHERE toxic = 1 AND rk <= k) AS hits, positives, round(count(*) FILTER (WHERE toxic = 1 AND rk <= k) / nullif(positives, 0), 6) AS recall FROM r, k, p GROUP BY k, positives"""
)
def recall_at_k(spark, d):
    return evaluation.recall_at(_judged(spark, d), "n", "toxic", "doc_id", (10, 50, 100, 500))


@_query(
    f"""WITH s AS (SELECT n, toxic, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS mr FROM {_JUDGED_SQL}), t AS (SELECT sum(mr) FILTER (WHERE toxic = 1) AS r, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE toxic <> 1) AS q FROM s)
    SELECT p AS positives, q AS negatives, round((r - p * (p + 1) / 2) / nullif(p * q, 0), 6) AS auc FROM t"""
)
def roc_auc(spark, d):
    return evaluation.roc_auc(_judged(spark, d), "n", "toxic")


@_query(
    f"""WITH t AS (SELECT unnest([1, 2, 3, 5])::INTEGER AS threshold) SELECT threshold, {_CELLS_SQL.replace('NOT hit', 'n < threshold').replace('hit', 'n >= threshold')} FROM {_JUDGED_SQL}, t GROUP BY threshold"""
)
def threshold_sweep(spark, d):
    swept = _judged(spark, d).groupBy("n", "toxic").agg(F.count("*").alias("rows"))
    cell = lambda on, label, t: F.coalesce(F.sum(F.when((F.col("n") >= t if on else F.col("n") < t) & (F.col("toxic") == label), F.col("rows"))), F.lit(0))
    rows = [F.struct(F.lit(t).alias("threshold"), cell(True, 1, t).alias("tp"), cell(True, 0, t).alias("fp"), cell(False, 1, t).alias("fn"), cell(False, 0, t).alias("tn")) for t in (1, 2, 3, 5)]
    return swept.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


_BUCKET_SQL = "(('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::BIGINT % 10)"


@_query(f"SELECT doc_id, CASE WHEN {_BUCKET_SQL} < 8 THEN 'train' WHEN {_BUCKET_SQL} = 8 THEN 'validation' ELSE 'test' END AS split FROM documents")
def train_split(spark, d):
    return load(spark, d, "documents").select("doc_id", evaluation.split_of("doc_id").alias("split"))


@_query()
def toxic_classifier(spark, d):
    """Hashed words and logistic regression, fit on the training split, judged on the test split."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    labelled = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select(evaluation.split_of("doc_id").alias("split"), F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("double").alias("label"))
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern="[ \\n.,!]+"), HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 14, binary=True), LogisticRegression(maxIter=20, regParam=0.01)]
    model = Pipeline(stages=stages).fit(labelled.where("split = 'train'"))
    scored = model.transform(labelled.where("split = 'test'"))
    return evaluation.rates(evaluation.confusion(scored, F.col("prediction") == 1, F.col("label") == 1))


@_query()
def screen_latency(spark, d):
    """Percentiles of the wall time of ten runs of the lexicon screen."""
    took = []
    for _ in range(10):
        began = time.perf_counter()
        confusion_matrix(spark, d).collect()
        took.append((time.perf_counter() - began,))
    return spark.createDataFrame(took, "s double").agg(*[F.percentile("s", F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)])


# streaming


@_query(_HITS_SQL)
def stream_rule_hits(spark, d):
    return screens.rule_stream(spark, overlay.conversations(load(spark, d, "conversations")))


@_query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value::DECIMAL(20,6))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, d):
    return screens.tumbling_counts(spark, d)


@_query(
    """WITH s AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS begun, event_type, value FROM events)
    SELECT begun, event_type, count(*) AS n, round(sum(value::DECIMAL(20,6))::DOUBLE, 4) AS total FROM s GROUP BY 1, 2"""
)
def stream_sliding_counts(spark, d):
    return screens.sliding_counts(spark, d)


@_query(
    """WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, min(ts) AS begun, count(*) AS n FROM s GROUP BY user_id, g"""
)
def stream_sessions(spark, d):
    return screens.sessions(spark, d)


@_query("SELECT event_id, user_id, event_type FROM events")
def stream_deduplicated(spark, d):
    return screens.deduplicated(spark, d)


@_query(f"SELECT conv_id, count(*) AS n_turns, round(sum({_sql_score(_sql_hits('text'))}), 6) AS score FROM {overlay.CONVERSATIONS_SQL} GROUP BY conv_id")
def stream_running_scores(spark, d):
    return screens.running_scores(spark, overlay.conversations(load(spark, d, "conversations")))


_TIMED_SQL = f"(SELECT conv_id, turn, text, make_timestamp((1704067200 + (conv_id % 997) * 60 + turn * 40) * 1000000) AS ts FROM {overlay.CONVERSATIONS_SQL})"


@_query(
    f"""WITH x AS (SELECT conv_id, turn, ts, {_sql_score(_sql_hits('text'))} AS s FROM {_TIMED_SQL})
    SELECT conv_id, count(*) AS n_turns, round(sum(s), 6) AS score, coalesce(array_to_string(list(turn ORDER BY turn) FILTER (WHERE s >= 0.7), ','), '') AS flagged, min(ts) AS begun, max(ts) AS ended FROM x GROUP BY conv_id"""
)
def stream_closed_conversations(spark, d):
    """Conversations that a timer closes when no turn has come for ten minutes."""
    return screens.closed_conversations(spark, overlay.conversations(load(spark, d, "conversations")))


@_query(
    f"""WITH x AS (SELECT conv_id, turn, ts, {_sql_score(_sql_hits('text'))} AS s FROM {_TIMED_SQL})
    SELECT a.conv_id, a.turn, f.turn AS flag_turn FROM x a LEFT JOIN x f ON a.conv_id = f.conv_id AND f.s >= 0.7 AND f.ts > a.ts AND f.ts <= a.ts + INTERVAL 2 MINUTE"""
)
def stream_followed_turns(spark, d):
    """Turns with the flags that follow within two minutes, two streams joined."""
    return screens.followed_turns(spark, overlay.conversations(load(spark, d, "conversations")))
