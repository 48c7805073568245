"""Deterministic review rules over notices (id, meta, docs), as column expressions within the row, without
a shuffle; Python only reads the evidence of v22 back from its source.

v2: an eligibility section asks for experience with a lower bound of money although the estimate is below the law's
threshold. v3: that bound is above the allocated budget. v22: a negotiated contract admits only those who attended a
briefing. Unknown metadata decides 0 and stays visible; evidence never changes a decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import LINE_END, MONEY, NUMBERED, amount, let, levels, money, running, safe, source_slice, squeeze

# Thresholds, words and patterns the rules are defined by.
THRESHOLD = {"국가계약법": 230_000_000, "지방계약법": 230_000_000}
# Headings may be numbered, bulleted, spaced out, or have a short parenthesis.
ELIGIBILITY = r"^(?:(?:제?\d+[.、):장절]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+[.、)]?|[가-하][.)]|[□■○◦●ㅇ※-])?)(?:입찰|제안|경쟁입찰|견적제출|입찰및제안)?(?:참가|참여|신청)(?:자격|업체자격|조건)|^(?:입찰|제안)업체(?:참가)?자격"
ELIGIBILITY_TAIL = r"^(?:및(?:방법|입찰절차))?(?:[:：].*|\(.*|※.*|은(?:아래|다음)조건.*)?$"
DOCUMENT_GUIDANCE = r"등록증|면허증|허가증|사본|첨부|제출서류"
SECTION_PREFIX = r"(?:(?:제?\d+[.、):장절]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+[.、)]?|[가-하][.)]|[□■○◦●ㅇ※-]))?"
FORM_HEADING = r"^" + SECTION_PREFIX + r"(?:[【\[(](?:별지)?서식[^】\])]*[】\])]|(?:별지)?서식\d+(?:호)?$)"
EVALUATION_HEADING = r"^" + SECTION_PREFIX + r"(?:정량(?:적)?평가(?:항목(?:및배점)?)?|평가항목(?:및배점)?|(?:유사(?:용역|사업))?(?:수행)?실적평가기준)(?:$|[:：\(].*|\d+점$)"
STOP = r"^(?:[□■○◦●ㅇ-]|제?\d+[.、):장절]|[가-하][.)])?(?:입찰보증|제출서류|제안서제출|입찰서제출|낙찰|평가|심사|계약체결|대금|정산|기타사항|문의|유의사항|서식|별지|붙임)"
DEADLINE_REQUIREMENT = r"^" + SECTION_PREFIX + r"(?:입찰서|제안서)제출마감일.*(?:까지|이전).*(?:자격|갖추|구비|등록|소지|업체)"
EXCLUDED = r"배점|평가표|점수표|정량평가|정성평가|평가구간|작성요령|작성예시|작성기준|계약후|계약체결후|착수후|준공후|정산|사후보고"
CLAUSE_END = r"\n\s*\n|\n(?=\s*(?:[-○◦●□■※]|[가-하][.)]|[①-⑳]|\d+[.)])\s*)"
BRIEFING = r"(?:[가-힣()·]*설명회|현장설명)"
ABSENT = r"(?:불참|미참석|미참가|참석하지\s*(?:않|아니)|참가하지\s*(?:않|아니)|참석하지\s*못)"
ELIGIBLE = r"(?:입찰(?:\s*참가)?|제안서(?:\s*제출|\s*접수)?)"
DENIAL = r"(?:불가|금지|제외|허용되지|할\s*수\s*없|받지\s*않|접수하지\s*않|제출하지\s*못|참가하지\s*못)"
ATTENDANCE = [
    ("eligibility_list", rf"(?:입찰|용역수행)\s*참가\s*자격(?:(?![.!?]\s*\d+\. ).){{0,700}}?{BRIEFING}에?\s*(?:참석|참가|참여)한\s*(?:자|업체)"),
    ("absent_excluded", rf"{BRIEFING}.{{0,40}}?{ABSENT}.{{0,60}}?{ELIGIBLE}.{{0,35}}?{DENIAL}"),
    ("attendees_only", rf"{BRIEFING}.{{0,25}}?(?:참석|참가|참여).{{0,30}}?(?:한하|한해|자만|업체만|업체에만|자에만).{{0,45}}?{ELIGIBLE}.{{0,35}}?(?:가능|자격|허용|있|부여)"),
]
PRESENTATION = r"제안(?:서)?\s*설명회\s*\(평가\)|평가위원.*설명회|평가\s*대상.{0,10}제외"
# What every eligibility heading and every sentence about a briefing holds: texts without it need no closer look.
HEADED = r"(?U)자\s*격|조\s*건"
BRIEFED = r"설명회|현장설명"
SPECIAL = r"특수\s*기술|특수\s*공법"
NEGOTIATED = r"협상에\s*의한\s*계약|계약\s*방법\s*[:：]?\s*협상"

_OPEN, _CLOSE = "\x01", "\x02"
_NEAR = 40  # characters on either side of a match that are kept with it
NOTICE = "id string, meta map<string,string>, docs array<struct<doc_id:string,type:string,text:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, match, before, after) for every match: its offset, and up to 40 characters on either side."""
    pieces = F.split(F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "  "), f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)
    none = F.array().cast("array<struct<start:bigint,match:string,before:string,after:string>>")

    def found(z):
        def one(i):
            piece = F.get(z["marked"], i)
            # A piece but the first holds a match, hence a character: so many pieces are enough on either side.
            before = F.array_join(F.slice(z["plain"], F.greatest(i - _NEAR, F.lit(0)) + 1, F.least(i, F.lit(_NEAR))), "")
            after = F.concat(F.substring_index(piece, _CLOSE, -1), F.array_join(F.slice(z["plain"], i + 2, F.lit(_NEAR)), ""))
            return F.struct(F.get(z["at"], i).alias("start"), F.substring_index(piece, _CLOSE, 1).alias("match"), F.right(before, F.lit(_NEAR)).alias("before"), F.left(after, F.lit(_NEAR)).alias("after"))

        return F.when(F.size(z["marked"]) > 1, F.transform(F.sequence(F.lit(1), F.size(z["marked"]) - 1), one)).otherwise(none)

    def counted(plain, marked):
        return let(F.struct(marked.alias("marked"), plain.alias("plain"), running(F.transform(plain, F.length)).alias("at")), found)

    return let(pieces, lambda p: let(F.transform(p, lambda x: F.translate(x, _CLOSE, "")), lambda plain: counted(plain, p)))


def sections(text: Column) -> Column:
    """Texts of the eligibility sections: a fold over the lines, whose closing depends on the open heading's number."""

    def line(raw):
        flat = squeeze(raw)
        head = F.regexp_extract(flat, ELIGIBILITY, 0)
        tail = F.substr(flat, F.length(head) + 1)
        return F.struct(
            raw.alias("raw"), ((F.length(flat) <= 90) & (head != "") & tail.rlike(ELIGIBILITY_TAIL) & ~tail.rlike(DOCUMENT_GUIDANCE)).alias("opens"),
            (flat.rlike(FORM_HEADING) | flat.rlike(EVALUATION_HEADING) | (flat.rlike(STOP) & ~flat.rlike(DEADLINE_REQUIREMENT))).alias("stops"),
            F.regexp_extract(flat, NUMBERED, 1).alias("number"), levels(flat).alias("level"),
        )

    def step(a, x):
        lower = x["level"].isNotNull() & a["level"].isNotNull() & ((x["level"] < a["level"]) | ((x["level"] == a["level"]) & (x["number"] != a["number"])))
        ends = a["open"] & (x["opens"] | x["stops"] | F.coalesce(lower, F.lit(False)))
        done = F.when(ends, F.array_append(a["done"], a["now"])).otherwise(a["done"])
        still = a["open"] & ~ends
        return F.struct(
            (x["opens"] | still).alias("open"), F.when(x["opens"], x["raw"]).when(still, F.concat(a["now"], x["raw"])).otherwise(F.lit("")).alias("now"),
            F.when(x["opens"], x["number"]).otherwise(a["number"]).alias("number"), F.when(x["opens"], x["level"]).otherwise(a["level"]).alias("level"), done.alias("done"),
        )

    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("now"), F.lit("").alias("number"), F.lit(None).cast("int").alias("level"), F.array().cast("array<string>").alias("done"))
    found = F.aggregate(F.transform(F.split(text, LINE_END), line), start, step, lambda a: F.when(a["open"], F.array_append(a["done"], a["now"])).otherwise(a["done"]))
    return F.when(text.isNull() | text.rlike(HEADED), found).otherwise(F.array().cast("array<string>"))


def clauses(section: Column) -> Column:
    parts = F.split(F.regexp_replace(section, f"({CLAUSE_END})", f"$1{_OPEN}"), _OPEN)
    return F.filter(F.transform(parts, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), lambda c: c != "")


def bounds(clause: Column) -> Column:
    """(amount, evidence) of every lower bound of experience in a clause; none if the clause is about scores or caps."""
    flat = squeeze(clause)
    asked = F.contains(flat, F.lit("실적")) & ~flat.rlike(EXCLUDED) & ~(F.contains(clause, F.lit("|")) & flat.rlike("배점|점수|평가")) & ~flat.rlike("미만|이하")
    found = F.filter(matches(clause, MONEY), lambda m: squeeze(F.substring(m["after"], 1, 18)).rlike(r"^(?:\([^)]{0,8}\))?(?:이상|초과)"))

    def one(m):
        begin = F.greatest(m["start"] - 180, F.lit(0)).cast("int")
        return F.struct(money(m["match"]).alias("amount"), safe(F.substr(clause, begin + 1, F.lit(500))).alias("evidence"))

    return F.when(asked, F.transform(found, one)).otherwise(F.array().cast("array<struct<amount:bigint,evidence:string>>"))


def briefing(docs: Column) -> Column:
    """(rule, doc_id, text, start, size) of the first surviving match over documents, patterns and places; NULL if none.
    Matches are looked for in the collapsed text; `text` is the source, `start` and `size` count collapsed characters."""

    def of(doc):
        text = F.regexp_replace(doc["text"], r"(?U)[\s\x1c-\x1f]+", " ")
        each = []
        for name, pattern in ATTENDANCE:
            kept = F.filter(matches(text, pattern), lambda m: ~F.concat(F.right(m["before"], F.lit(35)), m["match"]).rlike(PRESENTATION))
            each.append(F.transform(kept, lambda m, name=name: F.struct(F.lit(name).alias("rule"), doc["doc_id"].alias("doc_id"), doc["text"].alias("text"), m["start"].alias("start"), F.length(m["match"]).alias("size"))))
        return F.get(F.concat(*each), 0)

    return F.get(F.filter(F.transform(F.filter(docs, lambda d: d["text"].rlike(BRIEFED)), of), lambda m: m.isNotNull()), 0)


def judge(notices: DataFrame) -> DataFrame:
    """id, v2, v3, v22 (0/1), e2, e3, e22 (evidence or NULL), candidates (array), briefing_rule and sections (count)."""
    meta = lambda k: F.element_at("meta", k)
    rows = notices.withColumn("__sections", F.flatten(F.transform("docs", lambda d: sections(d["text"]))))
    rows = rows.withColumn("candidates", F.flatten(F.transform(F.flatten(F.transform("__sections", clauses)), bounds)))
    estimate, budget = amount(meta("입찰추정가격")), amount(meta("배정예산금액"))
    threshold = F.create_map(*(F.lit(x) for k, v in THRESHOLD.items() for x in (k, v)))[meta("적용계약법")]
    scope = F.coalesce(meta("업무구분"), F.lit("")).rlike("용역|물품|제조")
    special = (meta("적용계약법") == "지방계약법") & (meta("계약방법") == "수의계약") & F.exists("docs", lambda d: d["text"].rlike(SPECIAL))
    two = F.coalesce(estimate < threshold, F.lit(False)) & scope & ~F.coalesce(special, F.lit(False))
    told = F.coalesce(F.contains(meta("계약방법"), F.lit("협상")), F.lit(False)) | F.coalesce(F.contains(meta("낙찰방법"), F.lit("협상")), F.lit(False)) | F.exists("docs", lambda d: d["text"].rlike(NEGOTIATED))
    rows = rows.withColumns({
        "c2": F.when(two, F.col("candidates")).otherwise(F.slice("candidates", 1, 0)), "c3": F.filter("candidates", lambda c: c["amount"] > budget),
        "briefing": F.when(told, briefing(F.col("docs"))),
    })
    # The source's own characters: only texts with a match go to Python.
    rows = rows.withColumn("quote", source_slice(F.col("briefing.text"), F.col("briefing.start"), F.col("briefing.size")))
    hit = lambda c: (F.size(c) > 0).cast("int")
    return rows.select(
        "id", hit("c2").alias("v2"), hit("c3").alias("v3"), F.col("briefing").isNotNull().cast("int").alias("v22"), F.get("c2", 0)["evidence"].alias("e2"),
        F.get("c3", 0)["evidence"].alias("e3"), safe(F.substring("quote", 1, 500)).alias("e22"), "candidates", F.col("briefing.rule").alias("briefing_rule"),
        F.size("__sections").alias("sections"),
    )


def override(model: DataFrame, ruled: DataFrame, items: list[str]) -> DataFrame:
    """Model verdicts (id, item, verdict) with those of the ruled items (wide by item) in their place."""
    long = ruled.unpivot(["id"], items, "item", "ruled")
    return model.join(long, ["id", "item"], "left").select("id", "item", F.coalesce("ruled", "verdict").alias("verdict"))
