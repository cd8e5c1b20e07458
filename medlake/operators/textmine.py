"""Findings in reports by match-level negation and hedging, anatomy scopes, and concept banks."""

from __future__ import annotations

import ast
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.functions.text import let

#: Cues before and behind a finding, cues that negate nothing, and what ends a clause.
PRE_NO = r"\b(?:no|not|never|without|absence of|absent|no evidence of|no evidence for|no sign of|no signs of|no findings? of|no definite|no significant|no convincing|negative for|free of|clear of|resolution of|resolved|rule out|r/o|to exclude|denies|unremarkable for|no ct (?:evidence|findings?) of)\b"
POST_NO = r"\b(?:is absent|are absent|was absent|were absent|not seen|not present|not identified|not demonstrated|not visualized|not appreciated|not detected|is not seen|not observed|could not be observed|ruled out|excluded|has resolved|have resolved|resolved|is unremarkable|are unremarkable|is normal|are normal)\b"
PRE_MAY = r"\b(?:possible|possibly|probable|probably|likely|may|may be|might|could (?:be|represent)|suspicious for|suspected|concerning for|questionable|question of|equivocal|indeterminate|cannot exclude|cannot be excluded|cannot rule out|can not exclude|differential|presumed|compatible with|consistent with|worrisome for|favor(?:ed|s)?)\b"
POST_MAY = r"is possible|cannot be excluded|can not be excluded|cannot be ruled out|is suspected|is questioned|versus|vs\.?|or (?:other|less likely)|\?"
PSEUDO = r"no significant change|no significant interval change|no interval change|no change|not significantly changed|no new|not significantly|no longer|not only|not just|no definite interval|without significant change"
STOPS = r"\bbut\b|\bhowever\b|\balthough\b|\bthough\b|\bexcept\b|\byet\b|\bwhich (?:demonstrates|shows|reveals|is)\b|\bwith\b|\bas well as\b|\baside from\b|\bother than\b"
PRESENT, UNCERTAIN, ABSENT = 1, -1, 0

#: Rules of this library: (presence pattern, vetoed sentences) of each finding.
CHEST: dict[str, tuple[str, str]] = {
    "pleural_effusion": (r"pleural (?:effusions?|fluid)|\bhydrothorax\b", r"pericardial recess"),
    "pericardial_effusion": (r"pericardial (?:effusions?|fluid)", ""),
    "pneumothorax": (r"\bpneumothora(?:x|ces)\b", ""),
    "consolidation": (r"\bconsolidat(?:ion|ions|ive)\b|airspace disease", ""),
    "pneumonia": (r"\bpneumonias?\b", ""),
    "ground_glass": (r"ground.glass", ""),
    "atelectasis": (r"\batelecta(?:sis|ses|tic)\b", ""),
    "lung_nodule": (r"(?:lung|pulmonary) (?:nodules?|micronodules?)|\bnodules?\b", r"thyroid|adrenal"),
    "lung_mass": (r"(?:lung|pulmonary) mass(?:es)?", ""),
    "emphysema": (r"\bemphysema(?:tous)?\b", r"subcutaneous"),
    "fibrosis": (r"\bfibro(?:sis|tic)\b|honeycombing", r"hepatic|liver"),
    "bronchiectasis": (r"\bbronchiecta(?:sis|tic)\b", ""),
    "edema": (r"pulmonary (?:o?edema)|septal thickening", ""),
    "embolism": (r"pulmonary (?:embol(?:us|i|ism))", ""),
    "cardiomegaly": (r"\bcardiomegaly\b|enlarged heart", ""),
    "coronary_calcification": (r"coronary (?:artery )?calcifications?", ""),
    "lymphadenopathy": (r"\blymphadenopathy\b|enlarged lymph nodes?", ""),
    "hiatal_hernia": (r"hiatal hernias?", ""),
}
ABDOMEN: dict[str, tuple[str, str]] = {
    "ascites": (r"\bascites\b|free fluid", ""),
    "free_air": (r"free air|\bpneumoperitoneum\b", ""),
    "steatosis": (r"\bsteatosis\b|fatty (?:liver|infiltration)", ""),
    "cirrhosis": (r"\bcirrho(?:sis|tic)\b", ""),
    "liver_lesion": (r"(?:liver|hepatic) (?:lesions?|mass(?:es)?)", ""),
    "hepatomegaly": (r"\bhepatomegaly\b|enlarged liver", ""),
    "gallstones": (r"\bgallstones?\b|\bcholelithiasis\b", ""),
    "cholecystitis": (r"\bcholecystitis\b", ""),
    "biliary_dilation": (r"(?:biliary|ductal) dilat(?:ion|ation)", ""),
    "splenomegaly": (r"\bsplenomegaly\b|spleen is enlarged", ""),
    "pancreatitis": (r"\bpancreatitis\b", ""),
    "pancreatic_cyst": (r"pancreatic cysts?", ""),
    "adrenal_nodule": (r"adrenal (?:nodules?|mass(?:es)?|adenomas?)", ""),
    "renal_cyst": (r"(?:renal|kidney) cysts?", ""),
    "renal_stone": (r"(?:renal|kidney) stones?|\bnephrolithiasis\b", ""),
    "renal_mass": (r"(?:renal|kidney) mass(?:es)?", ""),
    "hydronephrosis": (r"\bhydronephrosis\b", ""),
    "renal_atrophy": (r"(?:renal|kidney) atrophy|atrophic kidneys?", ""),
    "bladder_thickening": (r"bladder wall thickening", ""),
    "prostate_enlargement": (r"prostatomegaly|enlarged prostate", ""),
    "fibroids": (r"\bfibroids?\b", ""),
    "ovarian_cyst": (r"(?:ovarian|adnexal) cysts?", ""),
    "bowel_obstruction": (r"bowel obstruction|\bileus\b", ""),
    "bowel_thickening": (r"bowel wall thickening|\bcolitis\b|\benteritis\b", ""),
    "appendicitis": (r"\bappendicitis\b", ""),
    "diverticulosis": (r"\bdiverticulosis\b", ""),
    "diverticulitis": (r"\bdiverticulitis\b", ""),
    "abdominal_hernia": (r"(?:inguinal|ventral|umbilical) hernias?", ""),
    "aortic_aneurysm": (r"aortic aneurysms?", ""),
    "aortic_calcification": (r"aort(?:a|ic) (?:wall )?(?:calcifications?|atheroma)", ""),
}


def _rank(clause: Column, pattern: str) -> Column:
    """2 for a present, 1 for an uncertain, 0 for an absent finding in a clause; null without a match.

    The clause is split at the matches: what stands before and behind each of them decides.
    """

    def judged(parts: Column) -> Column:
        def one(i: Column) -> Column:
            before = F.array_join(F.slice(parts, F.lit(1), i), "")
            behind = F.array_join(F.slice(parts, i + 1, F.size(parts)), "")
            stays = before.rlike(PSEUDO) | behind.rlike(PSEUDO)
            return F.when(~stays & (before.rlike(PRE_NO) | behind.rlike(POST_NO)), 0).when(before.rlike(PRE_MAY) | behind.rlike(POST_MAY), 1).otherwise(2)

        return F.when(F.size(parts) > 1, F.array_max(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), one)))

    return let(F.split(clause, pattern), judged)


def status(sentences: Column, pattern: str, veto: str = "") -> Column:
    """1 present, -1 uncertain or 0 absent (F12): present outweighs uncertain, which outweighs absent.

    Vetoed sentences say nothing, and a match before a colon is a header.
    """
    p = f"(?:{pattern})"
    low = F.transform(sentences, lambda s: F.regexp_replace(F.lower(s), f"{p}(s?\\s*:)", "$1"))
    told = F.filter(low, lambda s: s.rlike(p) & ~s.rlike(veto) if veto else s.rlike(p))
    clauses = F.flatten(F.transform(told, lambda s: F.split(s, STOPS)))
    best = F.array_max(F.transform(clauses, lambda c: _rank(c, p)))
    return F.when(best == 2, PRESENT).when(best == 1, UNCERTAIN).otherwise(ABSENT)


def finding_status(sentences: Column, rules: dict[str, tuple[str, str]]) -> Column:
    """Map of finding to 1, 0 or -1 for an array of sentences (F13); null is all absent."""
    return F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*(status(sentences, p, veto) for p, veto in rules.values())))


def binary(status: Column, uncertain_as: int = 1) -> Column:
    """Three states to two; missing is absent."""
    return F.when(status == UNCERTAIN, uncertain_as).when(status == PRESENT, 1).otherwise(0)


#: What opens the part of a phrase that only tells the cause or setting.
SECONDARY = r"\b(?:with|in the setting of|secondary to|due to)\b"


def anatomy(text: Column, scopes: dict[str, tuple[list[str], int]], overrides: list[tuple[str, str]] = (), priority: list[str] | None = None) -> Column:
    """Struct (system, score, reason, tied, candidates) of a phrase.

    The first override that matches decides.  Else weighted patterns are looked up in what
    stands before a secondary cue, and if that has none, in the whole phrase.  Ties in
    score go to the earlier match, then to the earlier system of ``priority``; several
    systems equal in score and place are OTHER, and a phrase without evidence is NONE.
    """
    order = priority or list(scopes)
    low = F.lower(F.coalesce(text, F.lit("")))
    shape = "struct<system:string,score:int,reason:string,tied:boolean,candidates:array<string>>"
    row = lambda system, score, reason, tied, found: F.struct(system.alias("system"), score.cast("int").alias("score"), F.lit(reason).alias("reason"), tied.alias("tied"), found.alias("candidates")).cast(shape)

    def scored(t: Column, reason: str) -> Column:
        each = []
        for name in order:
            patterns, weight = scopes[name]
            hits = reduce(lambda a, b: a + b, [t.rlike(p).cast("int") for p in patterns])
            first = F.array_min(F.array(*(F.nullif(F.regexp_instr(t, F.lit(p)), F.lit(0)) for p in patterns)))
            each.append(F.when(hits > 0, F.struct((-weight * hits).alias("s"), first.alias("at"), F.lit(order.index(name)).alias("o"), F.lit(name).alias("name"))))

        def chosen(found: Column) -> Column:
            best = F.get(found, F.lit(0))
            tied = F.exists(found, lambda x: (x["s"] == best["s"]) & (x["at"] == best["at"]) & (x["o"] != best["o"]))
            names = F.transform(found, lambda x: x["name"])
            return F.when(F.size(found) > 0, row(F.when(tied, "OTHER").otherwise(best["name"]), -best["s"], reason, tied, names))

        return let(F.sort_array(F.array_compact(F.array(*each))), chosen)

    head = F.get(F.split(low, SECONDARY), F.lit(0))
    none = F.array().cast("array<string>")
    ruled = reduce(lambda acc, r: acc.when(low.rlike(r[0]), row(F.lit(r[1]), F.lit(0), "override", F.lit(False), F.array(F.lit(r[1])))), overrides, F.when(F.lit(False), F.lit(None).cast(shape)))
    return F.coalesce(ruled, scored(head, "primary"), scored(low, "full"), row(F.lit("NONE"), F.lit(0), "none", F.lit(False), none))


def parse_observations(raw: Column) -> Column:
    """Text items under ``observations`` of a JSON or Python-literal document; anything else is empty.

    JSON is read by Spark; only what it can't read goes to Python.
    """
    none = F.array().cast("array<string>")
    parsed = F.try_parse_json(raw)
    listed = F.try_variant_get(parsed, "$.observations", "array<variant>")
    texts = F.transform(F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
    native = F.when(parsed.isNotNull(), F.coalesce(texts, none))

    @F.pandas_udf("array<string>")
    def literal(rows: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            try:
                got = ast.literal_eval(t or "")
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                return []
            found = got.get("observations") if isinstance(got, dict) else None
            return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []

        return pd.Series([one(t) for t in rows])

    return F.coalesce(native, literal(F.when(native.isNull(), raw)))


def bank(phrases: DataFrame, phrase: str) -> DataFrame:
    """(concept_index, concept): distinct trimmed lower-case phrases in order (F16).

    Positions are counts of smaller phrases: a prefix sum over first letters, then a rank
    inside each, so that no task sorts the whole bank.
    """
    p = phrases.select(F.lower(F.trim(phrase)).alias("concept")).where("concept <> ''").distinct().withColumn("_f", F.substring("concept", 1, 2))
    n = p.groupBy("_f").agg(F.count("*").alias("_n"))
    base = n.select("_f", F.coalesce(F.sum("_n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_f").orderBy("concept")) - 1
    return p.withColumn("_i", inside).join(base, "_f").select((F.col("_b") + F.col("_i")).alias("concept_index"), "concept")


def word_counts(texts: DataFrame, words: Column, stop: list[str], least: int = 3) -> DataFrame:
    """Counts of words that are long enough and not in the stop list."""
    w = texts.select(F.explode(words).alias("word"))
    return w.where((F.length("word") >= least) & ~F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("n"))
