"""Registered queries of these operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import pagemodel, qualitytrees
from newsloom.llm.decontaminate import leaks
from newsloom.llm.filteraudit import filter_audit
from newsloom.llm.labelledpages import labelled_pages
from newsloom.llm.langid import predict, train
from newsloom.llm.lexsearch import search
from newsloom.llm.licences import COPYRIGHT, PUNCTUATION, SPELLINGS, known, known_texts, licence_hits
from newsloom.llm.linededup import repeated_lines
from newsloom.llm.mixing import mixed
from newsloom.llm.neardup import near_duplicates
from newsloom.llm.packing import pack, tokenizer_path
from newsloom.llm.sketches import fingerprints
from newsloom.llm.urlrules import judge
from newsloom.llm.work import crc_part

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@case("op1_language_id")
def op1(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs.where(crc_part(5) != 0))
    return predict(docs, model).select("doc_id", F.coalesce(crc_part(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@case("op2_html_main_text")
def op2(spark, sf_dir):
    model = pagemodel.train(labelled_pages())
    return pagemodel.extract(pages(spark, sf_dir), model, keep=["page_id", "url"])


# Fixed: the rules that the query judges by.
RULES = [("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False)]


def _rules_sql() -> str:
    """The longest rule first."""
    cases = []
    for rule, allow in sorted(RULES, key=lambda r: -len(r[0])):
        host, _, path = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}'")
    return "CASE " + "\n        ".join(cases) + " END"


@case("op3_url_rules", rf"""
WITH parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages
),
ruled AS (
    SELECT *, {_rules_sql()} AS rule
    FROM parts
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ({", ".join(f"'{r}'" for r, allow in RULES if not allow)}) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""")
def op3(spark, sf_dir):
    return judge(pages(spark, sf_dir), RULES, keep=["page_id"])


def _canonical_sql(text: str) -> str:
    lower = f"translate(regexp_replace({text}, '{COPYRIGHT}', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"' ' || regexp_replace({lower}, '{PUNCTUATION}', ' ', 'g') || ' '"
    for other, one in SPELLINGS:
        out = f"replace({out}, ' {other} ', ' {one} ')"
    return f"md5(trim({out}))"


def _licences_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in known_texts())
    return rf"""
WITH known_raw(licence, t) AS (VALUES {rows}),
known AS (SELECT {_canonical_sql("t")} AS digest, min(licence) AS licence FROM known_raw GROUP BY 1),
units AS (
    SELECT doc_id, 'text' AS scope, 0 AS r, coalesce(text, '') AS t FROM documents
    UNION ALL
    SELECT doc_id, 'paragraph', 1, unnest(p) FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '
[ 	
]*
') AS p FROM documents) WHERE len(p) > 1
    UNION ALL
    SELECT doc_id, 'line', 2, unnest(l) FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) WHERE len(l) > 1
),
found AS (SELECT u.doc_id, k.licence, u.scope, u.r FROM (SELECT *, {_canonical_sql("t")} AS digest FROM units) u JOIN known k USING (digest))
SELECT doc_id, licence, arg_min(scope, r) AS scope, count(*) AS n_units FROM found GROUP BY doc_id, licence
"""


@case("op4_licence_scan", _licences_sql())
def op4(spark, sf_dir):
    return licence_hits(documents(spark, sf_dir), known(spark))


@case("op5_benchmark_decontamination")
def op5(spark, sf_dir):
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@case("op6_source_mixture", r"""
WITH RECURSIVE
d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
),
hist AS (SELECT source, size, count(*) AS n FROM d GROUP BY source, size),
sources AS (
    SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size, min(size) FILTER (size > 0) AS least,
        list({'s': size, 'n': n} ORDER BY size) AS groups
    FROM hist GROUP BY source
),
weighted AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap
    FROM sources
),
levels AS (
    SELECT *, cap / weight AS ratio,
        (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighted
),
targets AS (
    SELECT source, source_size, least, groups,
        CASE WHEN ratio <= level THEN cap ELSE weight * max(level) FILTER (ratio > level) OVER () END AS target
    FROM levels
),
halved(source, low, high, i) AS (
    SELECT source, CASE WHEN target >= source_size THEN 0.0::DOUBLE ELSE ln(target / source_size) / least END,
        CASE WHEN target >= source_size THEN ln(2.0::DOUBLE) / least ELSE 0.0::DOUBLE END, 0
    FROM targets WHERE least IS NOT NULL AND target < 2 * source_size
    UNION ALL
    SELECT h.source,
        CASE WHEN list_sum(list_transform(groups, lambda g: g.n * g.s * least(2.0::DOUBLE, exp((low + high) / 2 * g.s)))) < target THEN (low + high) / 2 ELSE low END,
        CASE WHEN list_sum(list_transform(groups, lambda g: g.n * g.s * least(2.0::DOUBLE, exp((low + high) / 2 * g.s)))) < target THEN high ELSE (low + high) / 2 END,
        i + 1
    FROM halved h JOIN targets t ON h.source IS NOT DISTINCT FROM t.source WHERE i < 100
),
rates AS (
    SELECT h.source, h.size, source_size, target, n,
        CASE WHEN t.least IS NULL THEN 1.0::DOUBLE WHEN target >= 2 * source_size THEN 2.0::DOUBLE
             WHEN target = source_size THEN 1.0::DOUBLE ELSE least(2.0::DOUBLE, exp((low + high) / 2 * h.size)) END AS rate
    FROM hist h JOIN targets t ON h.source IS NOT DISTINCT FROM t.source
    LEFT JOIN halved x ON x.i = 100 AND x.source IS NOT DISTINCT FROM h.source
),
placed AS (
    SELECT *, coalesce(sum(n * rate) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM rates
),
numbered AS (
    SELECT d.doc_id, d.source, d.size, source_size, target, rate, start,
        row_number() OVER (PARTITION BY d.source, d.size ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) AS j
    FROM d JOIN placed p ON d.size = p.size AND d.source IS NOT DISTINCT FROM p.source
),
copied AS (
    SELECT *, CAST(greatest(floor(rate), least(ceil(rate), floor(start + j * rate + 0.5) - floor(start + (j - 1) * rate + 0.5))) AS INTEGER) AS copies
    FROM numbered
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies, source FROM copied
""")
def op6(spark, sf_dir):
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@case("op7_fingerprints", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
ordered AS (
    SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d
    WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
texts AS (
    SELECT doc_id, n, text, next_text, substring(text, 1, n - n // 4) || substring(next_text, 1, n // 4) AS edited FROM ordered
),
parts AS (
    SELECT doc_id, 1 AS part, text AS t FROM texts
    UNION ALL SELECT doc_id, 2, edited FROM texts
    UNION ALL SELECT doc_id, 3, next_text FROM texts
),
words AS (SELECT doc_id, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM parts),
hashes AS (
    SELECT doc_id, part, list_transform(
        CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END,
        lambda s: substring(md5(s), 1, 16)) AS h
    FROM words
),
low AS (SELECT doc_id, part, list_sort(list_distinct(list_filter(h, lambda x: x < '2'))) AS k, h FROM hashes),
sketches AS (
    SELECT doc_id, part, CASE WHEN len(k) = 0 AND len(h) > 0 THEN [list_min(h)] ELSE k END AS s FROM low
),
sides AS (
    SELECT t.doc_id, t.n, sha256(t.edited) AS edited_sha256, a.s AS a, b.s AS b, c.s AS c
    FROM texts t JOIN sketches a ON a.doc_id = t.doc_id AND a.part = 1
    JOIN sketches b ON b.doc_id = t.doc_id AND b.part = 2 JOIN sketches c ON c.doc_id = t.doc_id AND c.part = 3
)
SELECT doc_id, n AS n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
    CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 1.0 END AS near_edited,
    CASE WHEN len(a) + len(c) > 0 THEN len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c))) ELSE 1.0 END AS near_next
FROM sides
""")
def op7(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))


@case("op8_minhash_near_dedup", r"""
WITH RECURSIVE
words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN []
             WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s
    FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM common o JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared >= 80 * (x.n + y.n - shared)
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN parts p ON p.doc_id = d.doc_id
""")
def op8(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=4, percent=80)


@case("op9_quality_trees")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_part(3) != 1)
    return qualitytrees.score(docs, qualitytrees.train(docs, labels)).select(
        "doc_id", F.coalesce(crc_part(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@case("op10_line_dedup", r"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
),
repeated AS (
    SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
    GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
marked AS (SELECT doc_id, i, line, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op10(spark, sf_dir):
    return repeated_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@case("op11_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
),
f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) < 200 AS fa,
        100 * len(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) < 50 * len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS fb,
        100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS fc,
        regexp_matches(t, '[#$%&*|]') AS fd,
        CASE WHEN d.doc_id IS NULL THEN min(d.doc_id) OVER (PARTITION BY t) IS NOT NULL
             ELSE d.doc_id > min(d.doc_id) OVER (PARTITION BY t) END AS fe
    FROM d LEFT JOIN marks m ON m.doc_id = d.doc_id
),
cells AS (
    SELECT part, fa, fb, fc, fd, fe, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS o
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l
),
steps AS (SELECT o, s, substring(o, s, 1) AS here, substring(o, 1, s - 1) AS before FROM orders, range(1, 6) r(s)),
judged AS (
    SELECT c.*, o, s, here,
        (contains(before, 'A') AND fa) OR (contains(before, 'B') AND fb) OR (contains(before, 'C') AND fc)
            OR (contains(before, 'D') AND fd) OR (contains(before, 'E') AND fe) AS earlier,
        CASE here WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END AS fails,
        fa::INT + fb::INT + fc::INT + fd::INT + fe::INT AS n_fails
    FROM cells c, steps
),
counted AS (
    SELECT part, o AS filter_order, s::INT AS step, here,
        sum(CASE WHEN NOT earlier AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN NOT earlier AND fails THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN earlier AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN NOT earlier AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN NOT earlier AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley
FROM counted
""")
def op11(spark, sf_dir):
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@case("op12_lexical_search", r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t, row_number() OVER () AS r
    FROM documents
),
stats AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS nd, sum(len(t)) AS nt FROM d),
postings AS (SELECT r, doc_id, term, count(*) AS tf, any_value(len(t)) AS n FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY r, doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
w AS (SELECT term, CAST(floor(1000.0 * ln((2.0 * nd + 2.0) / (2.0 * df + 1.0))) AS BIGINT) AS w FROM dfs, stats),
q AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
scored AS (
    SELECT q.item_id, p.r, p.doc_id,
        sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * s.nd) // s.nt)))) AS score
    FROM q JOIN postings p USING (term) JOIN w USING (term), stats s
    GROUP BY q.item_id, p.r, p.doc_id
),
ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank
    FROM scored WHERE score > 0 AND doc_id IS NOT NULL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
""")
def op12(spark, sf_dir):
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="item_id", k=10)


@case("op13_packing")
def op13(spark, sf_dir):
    return pack(documents(spark, sf_dir), tokenizer_path(), seq_len=4096)
