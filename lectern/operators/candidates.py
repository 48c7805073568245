"""Candidates for review: lines of a notice that speak of experience, ordering institutions or bidders' regions.

A line is judged with its neighbours: the context is the line, trimmed, between the `radius` non-blank lines before and
after it. Contexts about forms, places of delivery or scores are left out. All within the row, without a shuffle; the
flags see every line, only the evidence that is shown has a length. Null texts and notices without texts have no lines:
no flags and empty evidence, as has a null array of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import LINE_END, let, strip
from lectern.operators.rules import matches

# The patterns, units and limits that the candidates are defined by.
PATTERNS = {
    "experience": r"실적|수행실적|이행실적|납품실적|용역실적|수행 경험",
    "institution": r"국가기관|중앙정부|지방자치단체|지자체|공공기관|공기업|정부투자기관|대학병원|수요기관|특정 기관",
    "region": r"지역제한|지역\s*제한|본사|본점|주된\s*영업소|영업소|사업장\s*소재지|지역\s*업체|관내\s*업체|소재지를\s*둔\s*업체|소재하고\s*있는\s*업체|\[지역:[^\]]+\]",
    "basic": r"단위\s*=\s*기초|시[·ㆍ]?군[·ㆍ]?구|시군구|관내",
    "bad": r"평가장소|제출처|제출\s*장소|납품장소|발급기관|주소\s*[:：]|서식|양식|평가항목|평가요소|배점|평점|정량적\s*평가|계약\s*후|정산|성과보고",
    "qualification": r"입찰참가자격|입찰\s*참가\s*자격|참가자격|제한경쟁|입찰에\s*참가",
    "adjacent": r"인접|인근|접한\s*지역|연접|주변|확대|복수\s*지역",
    "token": r"\[지역:",
    "amount": r"\d[\d,]*(?:\.\d+)?\s*(?:억|천\s*만|백\s*만|만)?\s*원?",
}
UNITS = {"억": 100_000_000, "천만": 10_000_000, "백만": 1_000_000, "만": 10_000}
SHOWN = {"experience": 10, "institution": 10, "region": 15}


def amounts(text: Column, pattern: str = PATTERNS["amount"], units: dict[str, int] = UNITS) -> Column:
    """Array of (text, value, start): every number with its unit; the value is number x unit as doubles, cut to a whole one."""
    table = F.create_map(*(F.lit(x) for unit, times in units.items() for x in (unit, times)))

    def one(m):
        number = F.regexp_replace(F.regexp_extract(m["match"], r"^[\d,.]+", 0), ",", "").cast("double")
        unit = F.regexp_replace(F.regexp_extract(m["match"], "(" + "|".join(r"\s*".join(u) for u in units) + ")", 1), r"\s", "")
        return F.struct(m["match"].alias("text"), (number * F.coalesce(table[unit], F.lit(1))).cast("bigint").alias("value"), m["start"].cast("int").alias("start"))

    return F.transform(matches(text, pattern), one)


def lines(docs: Column) -> Column:
    """The trimmed lines of all texts in order, without blank ones."""
    whole = F.array_join(F.transform(docs, lambda d: F.coalesce(d["text"], F.lit(""))), "\n")
    return F.filter(F.transform(F.split(F.coalesce(whole, F.lit("")), LINE_END), strip), lambda x: x != "")


def contexts(said: Column, radius: int = 1) -> Column:
    """Array of (line, context) for an array of lines."""
    near = lambda z, i: F.slice(z, F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)) + radius + 1)
    return let(said, lambda z: F.transform(z, lambda x, i: F.struct(x.alias("line"), F.array_join(near(z, i), " ").alias("context"))))


def extract(notices: DataFrame, patterns: dict[str, str] = PATTERNS, radius: int = 1, shown: dict[str, int] = SHOWN) -> DataFrame:
    """From notices (id, docs): id, flags (v4 to v7, as far as they hold), n_experience, n_institution, n_region, amounts (of
    all experience contexts, in order), qualified (in any text), qualified_experience, qualified_region, and evidence:
    the first of each kind as arrays of (line, context, qualification, basic).

    v4: experience with an amount, and an institution. v5: a region. v6: a region of a basic unit. v7: regions that are
    called adjacent, or at least two marked ones. `patterns` overrides fixed ones by name."""
    use = {**PATTERNS, **patterns}
    holds = lambda c, name: c.rlike(f"(?U){use[name]}")
    rows = notices.select("id", lines(F.col("docs")).alias("said"))
    rows = rows.withColumn("near", F.filter(contexts(F.col("said"), radius), lambda x: ~holds(x["context"], "bad")))

    def kind(name: str) -> Column:
        told = lambda x: F.struct(x["line"].alias("line"), x["context"].alias("context"), holds(x["context"], "qualification").alias("qualification"), holds(x["context"], "basic").alias("basic"))
        return F.transform(F.filter("near", lambda x: holds(x["context"], name)), told)

    rows = rows.withColumns({name: kind(name) for name in ("experience", "institution", "region")})
    rows = rows.withColumn("amounts", F.flatten(F.transform("experience", lambda x: amounts(x["context"], use["amount"]))))
    regions = F.array_join(F.transform("region", lambda x: x["context"]), " ")
    any_ = F.size("region") > 0
    flags = {
        "v4": (F.size("amounts") > 0) & (F.size("institution") > 0), "v5": any_, "v6": F.exists("region", lambda x: x["basic"]),
        "v7": any_ & (holds(regions, "adjacent") | (F.regexp_count(regions, F.lit(f"(?U){use['token']}")) >= 2)),
    }
    evidence = F.struct(*(F.slice(F.col(name), 1, n).alias(name) for name, n in shown.items()))
    return rows.select(
        "id", F.array_compact(F.array(*(F.when(on, name) for name, on in flags.items()))).alias("flags"), *(F.size(name).alias(f"n_{name}") for name in ("experience", "institution", "region")), "amounts",
        holds(F.array_join("said", "\n"), "qualification").alias("qualified"), F.exists("experience", lambda x: x["qualification"]).alias("qualified_experience"),
        F.exists("region", lambda x: x["qualification"]).alias("qualified_region"), evidence.alias("evidence"),
    )
