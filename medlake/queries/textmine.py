"""Text functions, rule classifiers and report mining over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.functions import text as tx
from medlake.operators import relational as rel
from medlake.operators import rules as ru
from medlake.operators import textmine as tm
from medlake.queries.common import registrar, rounded, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)


@query("text_completeness_split", "WITH t AS (SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'Not given.' WHEN d.doc_id % 10 = 1 THEN ' ' WHEN l.quality IS NULL THEN NULL ELSE text END AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, coalesce(lower(trim(t)) IN ('', 'not given', 'not given.'), true) AS missing FROM t")
def text_completeness_split(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    t = F.when(F.col("doc_id") % 10 == 0, "Not given.").when(F.col("doc_id") % 10 == 1, " ").when(F.col("quality").isNotNull(), F.col("text"))
    return d.select("doc_id", tx.missing_text(t).alias("missing"))


@query("pii_like_mask", f"SELECT conv_id, turn, regexp_matches(lower(text), '{tx.UNSAFE}') AS pii FROM conversations")
def pii_like_mask(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.pii_like(F.col("text")).alias("pii"))


@query("nfkc_key", r"SELECT doc_id, lower(trim(regexp_replace(nfc_normalize(text), '[\s\x0b\x{85}\x{a0}\p{Z}]+', ' ', 'g'))) AS key FROM documents")
def nfkc_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.nfkc(F.col("text")).alias("key"))


@query("tex_escape", r"SELECT p_partkey, replace(replace(replace(regexp_replace(replace(x, chr(92), chr(1)), '([&%$#_{}])', '\\\1', 'g'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), chr(1), '\textbackslash{}') AS tex FROM (SELECT p_partkey, p_name || ' ' || chr(92) || ' & 5% of $' || p_size || ' #' || p_partkey || '_{' || p_brand || '}~^' AS x FROM part)")
def tex_escape(spark, sf):
    x = F.concat("p_name", F.lit(" \\ & 5% of $"), F.col("p_size").cast("string"), F.lit(" #"), F.col("p_partkey").cast("string"), F.lit("_{"), "p_brand", F.lit("}~^"))
    return table(spark, sf, "part").select("p_partkey", tx.tex(x).alias("tex"))


@query("few_shot_prompts", "SELECT conv_id, turn, 'Give the topic.' || chr(10) || chr(10) || 'Input: a cat' || chr(10) || 'Output: animals' || chr(10) || chr(10) || 'Input: a rose' || chr(10) || 'Output: plants' || chr(10) || chr(10) || 'Input: ' || text || chr(10) || 'Output:' AS prompt FROM conversations")
def few_shot_prompts(spark, sf):
    shown = [("a cat", "animals"), ("a rose", "plants")]
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.few_shot("Give the topic.", shown, F.col("text")).alias("prompt"))


GROUPS = {"asia": ["CHINA", "INDIA", "JAPAN"], "europe": ["FRANCE", "GERMANY"]}


@query("display_groups", "SELECT n_nationkey, CASE WHEN n_name IN ('CHINA', 'INDIA', 'JAPAN') THEN 'Asia' WHEN n_name IN ('FRANCE', 'GERMANY') THEN 'Europe' ELSE 'Other' END AS shown FROM nation")
def display_groups(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", tx.display_group(F.col("n_name"), GROUPS).alias("shown"))


@query("prompt_pairs", "SELECT DISTINCT event_type AS positive, 'no ' || event_type AS negative, 'Report: ' || event_type || '. Impression:' AS prompt FROM events")
def prompt_pairs(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("positive")).distinct()
    return e.select("positive", F.concat(F.lit("no "), "positive").alias("negative"), F.format_string("Report: %s. Impression:", "positive").alias("prompt"))


SQUEEZE = "trim(regexp_replace({}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


@query("dedup_text", f"SELECT substr(sha1(t), 1, 16) AS id, min(doc_id) AS first_doc, count(*) AS n FROM (SELECT doc_id, {SQUEEZE.format('text')} AS t FROM documents) GROUP BY 1")
def dedup_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tx.text_id(tx.squeeze(F.col("text"))).alias("id"))
    return d.groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("text_quality_mask", "SELECT conv_id, turn, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) >= 3 AS good FROM conversations")
def text_quality_mask(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", (tx.letters(F.col("text")) >= 3).alias("good"))


@query("slugify", "SELECT p_partkey, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("sentence_split", r"SELECT doc_id, len(s) AS n_sentences, s[1] AS first FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.;!?])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.get("s", F.lit(0)).alias("first"))


STOP = ["the", "and", "with", "this", "that", "for", "was", "from"]


@query("word_frequency", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) WHERE length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in STOP) + ") GROUP BY 1")
def word_frequency(spark, sf):
    return tm.word_counts(table(spark, sf, "documents"), tx.tokens(F.col("text")), STOP)


@query("clean_length_stats", f"SELECT lang, round(avg(length(text)), 6) AS before, round(avg(length({SQUEEZE.format('text')})), 6) AS after, round(100.0 * (1 - sum(length({SQUEEZE.format('text')})) / sum(length(text))), 6) AS reduction_pct FROM documents GROUP BY 1")
def clean_length_stats(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.length("text").alias("a"), F.length(tx.squeeze(F.col("text"))).alias("b"))
    return rounded(d.groupBy("lang").agg(F.avg("a").alias("before"), F.avg("b").alias("after"), (100.0 * (1 - F.sum("b") / F.sum("a"))).alias("reduction_pct")))


_report = "'FINDINGS: clear. IMPRESSION: ' || text || '. Please call. Electronically signed by X'"
_put = ["'(?m)^[ \\t]*[0-9]+[.)][ \\t]+', ''", "'[*]+', ''", "'\\b[A-Z][a-zA-Z \\t\\r\\n]*:[ \\t\\r\\n]*', ''", "'(?m)^[ \\t]*[-\u2022][ \\t]+', ''"]
_body = "CASE WHEN instr(lower(c), 'impression:') > 0 THEN substr(c, instr(lower(c), 'impression:') + 11) WHEN instr(lower(c), 'findings:') > 0 THEN substr(c, instr(lower(c), 'findings:') + 9) ELSE c END"
for _p in _put:
    _body = f"regexp_replace({_body}, {_p}, 'g')"


@query("clean_report", f"""WITH t AS (SELECT doc_id, {_report} AS c FROM documents), b AS (SELECT doc_id, c, regexp_replace({SQUEEZE.format(_body)}, '(?i)(electronically signed|dictated by|report signed).*$', '', 'g') AS b FROM t),
 p AS (SELECT doc_id, c, list_filter(list_transform(string_split(b, '.'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(lower(x), 'discussed with|telephone|please call')) AS p FROM b), q AS (SELECT doc_id, c, p, list_transform(p, lambda x: lower(x)) AS l FROM p)
 SELECT doc_id, CASE WHEN c IS NULL OR trim(c) = '' THEN c WHEN len(p) = 0 THEN {SQUEEZE.format('c')} ELSE array_to_string(list_filter(p, lambda x, i: list_position(l, lower(x)) = i), '. ') || '.' END AS cleaned FROM q""")
def clean_report(spark, sf):
    t = F.concat(F.lit("FINDINGS: clear. IMPRESSION: "), "text", F.lit(". Please call. Electronically signed by X"))
    return table(spark, sf, "documents").select("doc_id", tx.clean_report(t).alias("cleaned"))


@query("drop_sections", f"""WITH t AS (SELECT doc_id, 'Note. Technique: helical scan.' || chr(10) || 'Findings: ' || text || chr(10) || 'Comparison Study: none' AS t FROM documents),
 p AS (SELECT doc_id, string_split(regexp_replace(t, '(?m)((?:^|[.\\n])[ \\t]*)([A-Z][A-Za-z]*(?: [A-Za-z]+){{0,4}}[ \\t]*:)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM t), k AS (SELECT doc_id, array_to_string(list_filter(p, lambda x, i: i = 1 OR NOT regexp_matches(split_part(x, ':', 1), '(?i)(technique|comparison)')), '') AS k FROM p) SELECT doc_id, {SQUEEZE.format('k')} AS kept FROM k""")
def drop_sections(spark, sf):
    t = F.concat(F.lit("Note. Technique: helical scan.\nFindings: "), "text", F.lit("\nComparison Study: none"))
    return table(spark, sf, "documents").select("doc_id", tx.drop_sections(t, ["technique", "comparison"]).alias("kept"))


BANK = "o AS (SELECT DISTINCT lower(trim(x)) AS concept FROM (SELECT unnest(string_split(p_name || ' | ' || p_type, '|')) AS x FROM part) WHERE trim(x) <> '')"


@query("observation_bank", f"WITH {BANK} SELECT row_number() OVER (ORDER BY concept) - 1 AS concept_index, concept FROM o")
def observation_bank(spark, sf):
    doc = F.to_json(F.struct(F.split(F.concat("p_name", F.lit(" | "), "p_type"), "[|]").alias("observations")))
    return tm.bank(table(spark, sf, "part").select(F.explode(tm.parse_observations(doc)).alias("phrase")), "phrase")


TAXONOMY = [("thing", "(widget|bolt|ring)"), ("colour", "(red|blue|green)"), ("size", "(small|medium|large|economy)")]


def _case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for n, p in TAXONOMY) + " ELSE 'other' END"


@query("taxonomy_first_match", f"SELECT p_partkey, {_case('lower(p_name)')} AS category FROM part")
def taxonomy_first_match(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ru.first_match(F.lower("p_name"), TAXONOMY).alias("category"))


HITS = {"vowelish": ("a.*a", "e.*e", "o"), "stop": ("t", "d$", "k"), "soft": ("l", "m", "n$")}


def _sum(ps):
    return " + ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER)" for p in ps)


@query("taxonomy_max_hits", "WITH h AS (SELECT p_partkey, " + ", ".join(f"{_sum(ps)} AS h{i}" for i, ps in enumerate(HITS.values())) + " FROM (SELECT p_partkey, lower(p_name) AS t FROM part)) SELECT p_partkey, CASE WHEN greatest(h0, h1, h2) = 0 THEN 'other' WHEN h0 >= h1 AND h0 >= h2 THEN 'vowelish' WHEN h1 >= h2 THEN 'stop' ELSE 'soft' END AS category FROM h")
def taxonomy_max_hits(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ru.most_hits(F.lower("p_name"), HITS).alias("category"))


PROFILE = ru.Profile(direct=("widget", "bolt"), associated=("ring", "small"), exclude=("promo",), global_exclude=("red",))
T = """t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part), h AS (SELECT *, list_filter(['red', 'promo'], lambda p: regexp_matches(t, p)) AS bad, list_filter(['widget', 'bolt'], lambda p: regexp_matches(t, p)) AS d, list_filter(['ring', 'small'], lambda p: regexp_matches(t, p)) AS a,
 least(len(list_filter(regexp_split_to_array(t, '[ ]+'), lambda w: w <> '')), 30) AS words FROM t),
 r AS (SELECT p_partkey, CASE WHEN len(bad) > 0 THEN 'excluded' WHEN len(d) > 0 THEN 'direct' WHEN len(a) > 0 THEN 'associated' ELSE 'rejected' END AS tier,
 CAST(CASE WHEN len(bad) > 0 THEN 0 WHEN len(d) > 0 THEN 100 + 5 * len(d) - words WHEN len(a) > 0 THEN 50 + 5 * len(a) - words ELSE 0 END AS INTEGER) AS score,
 array_to_string(CASE WHEN len(bad) > 0 THEN bad WHEN len(d) > 0 THEN d WHEN len(a) > 0 THEN a ELSE [] END, ',') AS matched FROM h)"""


def tiers(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", ru.tier(F.lower(F.concat("p_name", F.lit(" "), "p_type")), PROFILE).alias("r")).select("p_partkey", "p_brand", "r.tier", "r.score", F.array_join("r.matched", ",").alias("matched"))


@query("rule_tiering", f"WITH {T} SELECT p_partkey, tier, score, matched FROM r")
def rule_tiering(spark, sf):
    return tiers(spark, sf).drop("p_brand")


@query("tier_summary", f"WITH {T}, s AS (SELECT p_brand, count(CASE WHEN tier = 'direct' THEN 1 END) AS d, count(CASE WHEN tier = 'associated' THEN 1 END) AS a FROM r JOIN part USING (p_partkey) GROUP BY 1) SELECT p_brand, d AS n_direct, a AS n_associated, CASE WHEN d >= 10 THEN 'ok' WHEN d + a >= 10 THEN 'support_only' WHEN d + a > 0 THEN 'review' ELSE 'empty' END AS status FROM s")
def tier_summary(spark, sf):
    s = tiers(spark, sf).groupBy("p_brand").agg(F.count_if(F.col("tier") == "direct").alias("n_direct"), F.count_if(F.col("tier") == "associated").alias("n_associated"))
    return s.withColumn("status", ru.review_status(F.col("n_direct"), F.col("n_associated")))


@query("audit_decision", f"WITH {T} SELECT CASE tier WHEN 'direct' THEN 'retain' WHEN 'associated' THEN 'support' WHEN 'excluded' THEN CASE WHEN contains(matched, 'red') THEN 'material' WHEN contains(matched, 'promo') THEN 'marketing' ELSE 'excluded_other' END ELSE 'no_rule' END AS decision, count(*) AS n FROM r GROUP BY 1")
def audit_decision(spark, sf):
    return tiers(spark, sf).groupBy(ru.audit(F.col("tier"), F.col("matched"), [("red", "material"), ("promo", "marketing")]).alias("decision")).agg(F.count("*").alias("n"))


CASCADE = [
    ("Brand#1", "^S", ru.Profile(direct=("small",), associated=("hot|large",), exclude=("promo",))),
    ("Brand#1", None, ru.Profile(direct=("widget",), associated=("ring",), global_exclude=("red",))),
    ("Brand#[23]", None, ru.Profile(direct=("bolt", "gear"), associated=("large",))),
]


def _tier_sql(p: ru.Profile) -> tuple[str, str]:
    any_ = lambda ps: " OR ".join(f"regexp_matches(t, '{x}')" for x in ps) or "false"
    n = lambda ps: " + ".join(f"CAST(regexp_matches(t, '{x}') AS INTEGER)" for x in ps) or "0"
    bad = any_(p.global_exclude + p.exclude)
    return (
        f"CASE WHEN {bad} THEN 'excluded' WHEN {any_(p.direct)} THEN 'direct' WHEN {any_(p.associated)} THEN 'associated' ELSE 'rejected' END",
        f"CASE WHEN {bad} THEN 0 WHEN {any_(p.direct)} THEN 100 + 5 * ({n(p.direct)}) - words WHEN {any_(p.associated)} THEN 50 + 5 * ({n(p.associated)}) - words ELSE 0 END",
    )


_when = [f"regexp_matches(p_brand, '{label}')" + (f" AND regexp_matches(p_type, '{cat}')" if cat else "") for label, cat, _ in CASCADE]
_cols = [f"CASE {' '.join(f'WHEN {w} THEN {_tier_sql(p)[i]}' for w, (_, _, p) in zip(_when, CASCADE))} ELSE {other} END" for i, other in ((0, "'rejected'"), (1, "0"))]


@query("profile_resolution", f"WITH x AS (SELECT *, lower(p_name || ' ' || p_type) AS t FROM part), y AS (SELECT *, least(len(list_filter(regexp_split_to_array(t, '[ ]+'), lambda w: w <> '')), 30) AS words FROM x) SELECT p_partkey, CAST(CASE {' '.join(f'WHEN {w} THEN {i}' for i, w in enumerate(_when))} ELSE -1 END AS INTEGER) AS profile, {_cols[0]} AS tier, CAST({_cols[1]} AS INTEGER) AS score FROM y")
def profile_resolution(spark, sf):
    r = ru.resolve(F.lower(F.concat("p_name", F.lit(" "), "p_type")), F.col("p_brand"), F.col("p_type"), CASCADE)
    return table(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.profile", "r.tier", "r.score")


#: Phrases in parts, so that every gate meets every modifier.
OPENERS = ["", "no", "there is no", "possible", "no significant", "lack of iv contrast,", "negative for", "normal", "small", "not"]
FINDS = ["pleural effusion", "Pulmonary  Nodule", "atheroscleroſis of the aorta", "ascites", "lymph node", "ground-glass opacity", "atelectasis", "free fluid", "ﬁbrosis"]
ENDS = ["", "is not present", "but stable", "has resolved", "absent", "in the left lung", "is not excluded", "; unchanged", "not dilated at this level"]
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_gates = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{kind}|{why}'" for p, kind, why in tx.POLARITY)
PH = f"ph AS (SELECT trim(a || ' ' || b || ' ' || c) AS phrase FROM (SELECT unnest({_list(OPENERS)}) AS a), (SELECT unnest({_list(FINDS)}) AS b), (SELECT unnest({_list(ENDS)}) AS c)), pt AS (SELECT phrase, lower(trim(regexp_replace(replace(replace(phrase, 'ſ', 's'), 'ﬁ', 'fi'), '\\s+', ' ', 'g'))) AS t FROM ph)"


def phrases(spark):
    each = lambda xs, name: F.explode(F.array(*map(F.lit, xs))).alias(name)
    p = spark.range(1).select(each(OPENERS, "a")).select("a", each(FINDS, "b")).select("a", "b", each(ENDS, "c"))
    return p.select(F.trim(F.concat_ws(" ", "a", "b", "c")).alias("phrase"))


@query("polarity", f"WITH {PH}, g AS (SELECT phrase, CASE {_gates} ELSE 'affirmative|affirmative' END AS g FROM pt) SELECT phrase, split_part(g, '|', 1) AS polarity, split_part(g, '|', 2) AS reason FROM g")
def polarity(spark, sf):
    return phrases(spark).select("phrase", tx.polarity(tx.nfkc(F.col("phrase"))).alias("p")).select("phrase", "p.*")


#: Themes of concepts, the first that matches.
THEMES = [
    ("Pericardial effusion / fluid", r"pericard|pneumopericard"),
    ("Aortic / coronary calcification", r"atheroscler|calcif|atheroma|\bcoronary\b|aneurysm"),
    ("Lymph nodes", r"lymph node|lymphaden|lymphangit"),
    ("Consolidation / ground-glass", r"consolidat|ground.?glass|infiltrat|pneumonic|airspace|opacit"),
    ("Pleural effusion / fluid", r"pleural|hydropneumothorax"),
    ("Ascites / free fluid", r"ascites|peritone|abdom|free fluid|intra-?abdominal|\bpelvis\b"),
    ("Atelectasis / collapse", r"atelecta|collapse"),
    ("Effusion / fluid", r"effusion|fluid"),
]


@query("theme_inference", f"WITH {PH} SELECT phrase, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in THEMES) + " END AS theme FROM pt")
def theme_inference(spark, sf):
    t = ru.first_match(tx.nfkc(F.col("phrase")), THEMES, "")
    return phrases(spark).select("phrase", F.nullif(t, F.lit("")).alias("theme"))


#: Sentences of made-up reports; each document id gets six of them, in front of its own text's first words.
SENTENCES = [
    "No pleural effusion or pneumothorax.", "Small left pleural effusion with adjacent atelectasis.", "Possible pneumonia in the right lower lobe.", "Cardiomegaly is not seen.",
    "Mild cardiomegaly, but no pericardial effusion.", "No significant change in the lung nodule.", "Emphysema and fibrosis.", "Thyroid nodule is noted.", "Gallstones are present without cholecystitis.",
    "Hepatic steatosis cannot be excluded.", "Consolidation has resolved.", "Coronary calcification versus stent.", "The spleen is enlarged.", "Nodules: none.", "Findings consistent with cirrhosis and ascites.",
    "Bowel obstruction is unlikely however free air is identified.", "No renal stones, renal cysts or hydronephrosis.",
]
RULES = tm.CHEST | tm.ABDOMEN
R = f"r AS (SELECT doc_id, list_transform(range(0, 6), lambda j: ({_list(SENTENCES)})[1 + (doc_id * (j + 1) + j * j) % {len(SENTENCES)}]) AS s FROM documents), s AS (SELECT doc_id, lower(unnest(s)) AS s FROM r)"


def _finding_sql(name: str, pattern: str, veto: str) -> str:
    p = f"(?:{pattern})"
    told = f"(SELECT doc_id, regexp_replace(s, '{p}(s?\\s*:)', '\\1', 'g') AS s FROM s)"
    where = f"regexp_matches(s, '{p}')" + (f" AND NOT regexp_matches(s, '{veto}')" if veto else "")
    clauses = f"(SELECT doc_id, unnest(regexp_split_to_array(s, '{tm.STOPS}')) AS c FROM {told} WHERE {where})"
    parts = f"(SELECT doc_id, regexp_split_to_array(c, '{p}') AS p FROM {clauses})"
    each = f"(SELECT doc_id, array_to_string(p[1:i], '') AS b, array_to_string(p[i + 1:], '') AS a FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM {parts}))"
    rank = f"CASE WHEN NOT (regexp_matches(b, '{tm.PSEUDO}') OR regexp_matches(a, '{tm.PSEUDO}')) AND (regexp_matches(b, '{tm.PRE_NO}') OR regexp_matches(a, '{tm.POST_NO}')) THEN 0 WHEN regexp_matches(b, '{tm.PRE_MAY}') OR regexp_matches(a, '{tm.POST_MAY}') THEN 1 ELSE 2 END"
    return f"SELECT doc_id, '{name}' AS finding, max({rank}) AS k FROM {each} GROUP BY doc_id"


FOUND = f"{R}, f AS ({' UNION ALL '.join(_finding_sql(n, *r) for n, r in RULES.items())}), k AS (SELECT doc_id, finding, CAST(CASE f.k WHEN 2 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS INTEGER) AS status FROM (SELECT doc_id, unnest({_list(RULES)}) AS finding FROM documents) LEFT JOIN f USING (doc_id, finding))"


@query("finding_status", f"WITH {FOUND} SELECT doc_id, finding, status FROM k")
def finding_status(spark, sf):
    bank = F.array(*map(F.lit, SENTENCES))
    report = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")), lambda j: F.get(bank, ((F.col("doc_id") * (j + 1) + j * j) % len(SENTENCES)).cast("int")))
    text = table(spark, sf, "documents").select("doc_id", F.array_join(report, "\n").alias("t"))
    return text.select("doc_id", F.explode(tm.finding_status(tx.sentences(F.col("t")), RULES)).alias("finding", "status"))


@query("finding_binary", f"WITH {FOUND} SELECT doc_id, finding, CAST(CASE WHEN status = 0 THEN 0 ELSE 1 END AS INTEGER) AS y FROM k")
def finding_binary(spark, sf):
    return finding_status(spark, sf).select("doc_id", "finding", tm.binary(F.col("status")).alias("y"))


SCOPES = {"CHEST": (["pleural|pulmonary|lung", "effusion", "atelecta"], 3), "ABDOMEN": (["ascites", "free fluid", "aort"], 3), "GENERAL": (["node", "fluid", "small"], 1)}
FIXED = [("ground.glass", "CHEST")]


def _scope_sql(t: str) -> str:
    each = []
    for o, (name, (ps, w)) in enumerate(SCOPES.items()):
        hits = " + ".join(f"CAST(regexp_matches({t}, '{p}') AS INTEGER)" for p in ps)
        first = "least(" + ", ".join(f"CASE WHEN regexp_matches({t}, '{p}') THEN strpos({t}, regexp_extract({t}, '{p}')) END" for p in ps) + ")"
        each.append(f"{{'s': -{w} * ({hits}), 'f': {first}, 'o': {o}, 'name': '{name}'}}")
    return f"list_sort(list_filter([{', '.join(each)}], lambda x: x.s < 0))"


@query("anatomy_classify", f"""WITH {PH}, h AS (SELECT phrase, t, regexp_split_to_array(t, '{tm.SECONDARY}')[1] AS head FROM (SELECT phrase, lower(phrase) AS t FROM ph)), c AS (SELECT phrase, t, {_scope_sql('head')} AS a, {_scope_sql('t')} AS b FROM h),
 d AS (SELECT phrase, regexp_matches(t, 'ground.glass') AS fixed, CASE WHEN len(a) > 0 THEN a ELSE b END AS x, len(a) > 0 AS head FROM c), e AS (SELECT *, NOT fixed AND len(x) > 1 AND len(list_filter(x, lambda y: y.s = x[1].s AND y.f = x[1].f)) > 1 AS tied FROM d)
 SELECT phrase, CASE WHEN fixed THEN 'CHEST' WHEN len(x) = 0 THEN 'NONE' WHEN tied THEN 'OTHER' ELSE x[1].name END AS system, CAST(CASE WHEN fixed OR len(x) = 0 THEN 0 ELSE -x[1].s END AS INTEGER) AS score, CASE WHEN fixed THEN 'override' WHEN len(x) = 0 THEN 'none' WHEN head THEN 'primary' ELSE 'full' END AS reason, tied,
 CASE WHEN fixed THEN 'CHEST' ELSE array_to_string(list_transform(x, lambda y: y.name), '+') END AS candidates FROM e""")
def anatomy_classify(spark, sf):
    a = phrases(spark).select("phrase", tm.anatomy(F.col("phrase"), SCOPES, FIXED).alias("a")).select("phrase", "a.*")
    return a.withColumn("candidates", F.array_join("candidates", "+"))


@query("latest_upsert", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_upsert(spark, sf):
    return rel.keep_one(table(spark, sf, "orders"), ["o_orderpriority"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_orderpriority", "o_orderkey", "o_totalprice")


