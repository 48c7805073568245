"""License scans: ordered signature rules over normalised words, with DataFrame functions only.

Hundreds of regular expressions (families x templates x versions, built below from a plain table) look for license
signatures. The rules' own keywords gate them: each distinct keyword is looked up once in a document's normalised words,
and a rule runs only where one of its keywords stands. A document's detections are intervals of words. They are put in order of start, and one
pass drops each that lies within another of the same or a higher priority. What survives gives labels and the score.

Everything happens within a row: no shuffle, no explode, rows are kept one to one. Nulls: a null text is empty (no
words, no labels, null positions, score 0). Empty table: empty result. Extra columns are not read.

Base phrases (`cc by`, `general public license`, `all rights reserved`) are reported at all their places and their
labels always stay; suppression is only for the rules.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and labels: fixed values of the query's contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Family: SPDX-like name, regular expression over lower-case words, keywords (by `|`) of which one must stand in the text, versions.
FAMILIES = [
    ("apache", r"apache(?: software)?", "apache", ["1.0", "1.1", "2.0"]),
    ("mit", r"(?:mit|expat)", " mit licen| mit |expat", []),
    ("mit-0", r"mit no attribution", "no attribution", []),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd", []),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd", []),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd", []),
    ("0bsd", r"(?:0bsd|bsd zero clause|zero clause bsd)", "bsd", []),
    ("bsd", r"(?:bsd|berkeley software distribution)", " bsd |berkeley software distribution", []),
    ("isc", r"(?:isc|internet systems consortium)", " isc |internet systems consortium", []),
    ("gpl", r"(?:gnu )?(?:general public license|gpl)", "general public license| gpl", ["1.0", "2.0", "3.0"]),
    ("lgpl", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)", "general public license| lgpl", ["2.0", "2.1", "3.0"]),
    ("agpl", r"(?:gnu )?(?:affero general public license|agpl)", "affero general public| agpl", ["1.0", "3.0"]),
    ("gfdl", r"(?:gnu )?(?:free documentation license|gfdl|fdl)", "free documentation license| gfdl| fdl", ["1.1", "1.2", "1.3"]),
    ("mpl", r"(?:mozilla public license|mpl)", "mozilla public| mpl", ["1.0", "1.1", "2.0"]),
    ("epl", r"(?:eclipse public license|epl)", "eclipse public| epl", ["1.0", "2.0"]),
    ("edl", r"(?:eclipse distribution license|edl)", "eclipse distribution| edl", ["1.0"]),
    ("cddl", r"(?:common development and distribution license|cddl)", "development and distribution| cddl", ["1.0", "1.1"]),
    ("cpl", r"(?:common public license|cpl)", "common public license| cpl", ["1.0"]),
    ("ipl", r"ibm public license", "ibm", ["1.0"]),
    ("eupl", r"(?:european union public licen[cs]e|eupl)", "european union public| eupl", ["1.0", "1.1", "1.2"]),
    ("cecill", r"cecill", "cecill", ["1.0", "1.1", "2.0", "2.1"]),
    ("artistic", r"(?:perl )?artistic", "artistic", ["1.0", "2.0"]),
    ("osl", r"(?:open software license|osl)", "open software license| osl", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", r"(?:academic free license|afl)", "academic free| afl", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("ofl", r"(?:sil )?(?:open font license|ofl)", "open font license| ofl", ["1.0", "1.1"]),
    ("bsl", r"(?:boost software license|boost)", "boost", ["1.0"]),
    ("busl", r"business source license", "business source", ["1.1"]),
    ("sspl", r"(?:server side public license|sspl)", "server side public| sspl", ["1"]),
    ("elastic", r"elastic", "elastic", ["2.0"]),
    ("zlib", r"(?:zlib libpng|zlib)", "zlib", []),
    ("libpng", r"(?:png reference library|libpng)", "png reference| libpng", ["2"]),
    ("ncsa", r"(?:university of illinois ncsa|ncsa)(?: open source)?", "ncsa", []),
    ("openssl", r"openssl", "openssl", []),
    ("php", r"php", "php", ["3.0", "3.01"]),
    ("psf", r"(?:python software foundation|psf)", "python software foundation| psf", ["2.0"]),
    ("ruby", r"ruby", "ruby", []),
    ("vim", r"vim", "vim", []),
    ("x11", r"x11", "x11", []),
    ("postgresql", r"postgresql", "postgresql", []),
    ("curl", r"curl", "curl", []),
    ("ms-pl", r"(?:microsoft public license|ms pl)", "microsoft public| ms pl", []),
    ("ms-rl", r"(?:microsoft reciprocal license|ms rl)", "microsoft reciprocal| ms rl", []),
    ("apsl", r"(?:apple public source license|apsl)", "apple public| apsl", ["1.0", "1.1", "1.2", "2.0"]),
    ("npl", r"(?:netscape public license|npl)", "netscape public| npl", ["1.0", "1.1"]),
    ("qpl", r"(?:q public license|qpl)", " q public| qpl", ["1.0"]),
    ("spl", r"sun public license", "sun public", ["1.0"]),
    ("w3c", r"w3c(?: software)?(?: notice)?", "w3c", []),
    ("zpl", r"(?:zope public license|zpl)", "zope public| zpl", ["1.1", "2.0", "2.1"]),
    ("upl", r"(?:universal permissive license|upl)", "universal permissive| upl", ["1.0"]),
    ("wtfpl", r"(?:do what the fuck you want to public license|wtfpl)", "the fuck you want| wtfpl", ["1.0", "2.0"]),
    ("unlicense", r"(?:unlicense|unlicence)", "unlicen", []),
    ("odbl", r"(?:open database license|odbl)", "open database license| odbl", ["1.0"]),
    ("odc-by", r"(?:open data commons attribution license|odc by)", "open data commons| odc by", ["1.0"]),
    ("pddl", r"(?:public domain dedication and license|pddl)", "public domain dedication| pddl", ["1.0"]),
    ("cc0", r"(?:cc0|creative commons zero|cc zero)", " cc0|commons zero| cc zero", ["1.0"]),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)", " cc by nc sa|commons by nc sa| cc attribution non|commons attribution non", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv\w*)", " cc by nc nd|commons by nc nd| cc attribution non|commons attribution non", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)", " cc by nc|commons by nc| cc attribution non|commons attribution non", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv\w*)", " cc by nd|commons by nd| cc attribution no|commons attribution no", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)", " cc by sa|commons by sa| cc attribution share|commons attribution share", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by", r"(?:cc by|creative commons attribution)", " cc by|commons attribution", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
]
#: Notices without a family: label, priority, weight, keyword, regular expression.
NOTICES = [
    ("public-domain", 2, 0.8, "public domain", r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain"),
    ("copyright", 1, 0.4, "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", 1, 0.4, "copyright", r"(?:19|20)\d\d copyright"),
    ("reserved", 1, 0.6, "reserved", r"all rights (?:are )?reserved"),
    ("reserved", 1, 0.5, "reserved", r"(?:some|no) rights reserved"),
    ("proprietary", 2, 0.7, "proprietary", r"proprietary and confidential"),
    ("proprietary", 2, 0.7, "confidential", r"confidential and proprietary"),
    ("proprietary", 2, 0.6, "permission", r"(?:without|no) (?:the )?(?:prior|express)(?: express| written)* permission"),
    ("no-derivatives", 1, 0.5, "may not be", r"may not be (?:copied|reproduced|redistributed|modified)(?: or (?:copied|reproduced|redistributed|modified))?"),
    ("mit", 3, 0.9, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 3, 0.9, "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 3, 0.9, "redistribution and use", r"redistribution and use in source and binary forms"),
    ("zlib", 3, 0.9, "this software is provided as is", r"this software is provided as is without any express or implied warranty"),
    ("unlicense", 3, 0.9, "unencumbered", r"this is free and unencumbered software released into the public domain"),
]
_GRANT = r"(?:licensed|released|distributed|available|published|provided|redistributed|covered|governed) (?:under|by) (?:the )?(?:terms of )?(?:the )?"
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"


@cache
def rules() -> tuple[tuple[str, int, float, str, str], ...]:
    """(label, priority, weight, keywords, regular expression over ` w0 w1 ... `) of all rules, in order."""
    out = [(label, p, w, key, rf" {expr}(?= )") for label, p, w, key, expr in NOTICES]
    for name, expr, key, versions in FAMILIES:
        spelt = re.sub(r"[-.]", " ", name)
        for v in versions:
            words = v.replace(".", " ")
            short = re.sub(r" 0$", "(?: 0)?", words)
            version = rf"(?: public| documentation)?(?: licen[cs]e)?(?: international| unported| generic)?(?: version| v)? ?v?{short}(?: or later| only)?"
            out.append((f"{name}-{v}", 5, 1.0, "spdx", rf" spdx license identifier {spelt} {short}(?: only| or later)?(?= )"))
            out.append((f"{name}-{v}", 4, 0.95, key, rf" {_GRANT}{expr}{version}(?: licen[cs]e)?(?= )"))
            out.append((f"{name}-{v}", 4, 0.9, key, rf" {expr}{version}(?= )"))
        out.append((name, 5, 1.0, "spdx", rf" spdx license identifier {spelt}(?= )"))
        out.append((name, 3, 0.9, key, rf" {_GRANT}{expr}(?: licen[cs]e)?(?= )"))
        out.append((name, 2, 0.7, key, rf" {expr} licen[cs]e(?= )" if "licen" not in expr else rf" {expr}(?= )"))
    return tuple(out)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def _let(value: str, name: str, use: str) -> str:
    """`use` with `value` computed once under `name`."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _places(pattern: str, norm: str, extra: str, kind: str) -> str:
    """Intervals of words (start, end exclusive as its negative, then `extra`) where the pattern matches `norm`.

    Folded in blocks of 256 pieces, so that a long list of intervals is not copied for each of its members.
    """
    parts = f"split(regexp_replace({norm}, {pattern}, '{_OPEN}$0{_CLOSE}'), '{_OPEN}')"
    inner = (
        f"aggregate(slice(z, i * 256 + 1, 256), named_struct('at', a.at, 'out', cast(array() AS array<{kind}>)), "
        f"(c, p) -> named_struct('at', c.at + {_spaces('p')}, 'out', if(instr(p, '{_CLOSE}') > 0, concat(c.out, array("
        f"named_struct('start', c.at, 'back', -(c.at + {_spaces(f'substring_index(p, {chr(39)}{_CLOSE}{chr(39)}, 1)')}){extra}))), c.out)))"
    )
    fold = (
        f"aggregate(sequence(0, (size(z) - 1) div 256), named_struct('at', 0, 'out', cast(array() AS array<array<{kind}>>)), "
        f"(a, i) -> {_let(inner, 'b', 'named_struct({q}at{q}, b.at, {q}out{q}, concat(a.out, array(b.out)))'.format(q=chr(39)))}, a -> flatten(a.out))"
    )
    return _let(parts, "z", fold)


_FOUND = "struct<start:int,back:int,down:int,label:string,weight:double>"
_LEVELS = range(1, 6)


def _survivors(found: str) -> str:
    """Labels, score and number of the detections that no other of the same or a higher priority contains."""
    start = ", ".join([*(f"'m{p}', -1" for p in _LEVELS), "'labels', cast(array() AS array<string>)", "'score', 0D", "'n', 0"])
    reach = "CASE -d.down " + " ".join(f"WHEN {p} THEN a.m{p}" for p in _LEVELS) + " END"
    keep = f"({reach} < -d.back)"
    step = [
        *(f"'m{p}', if(-d.down >= {p}, greatest(a.m{p}, -d.back), a.m{p})" for p in _LEVELS),
        f"'labels', if({keep}, array_union(a.labels, array(d.label)), a.labels)",
        f"'score', if({keep}, greatest(a.score, d.weight), a.score)",
        f"'n', a.n + if({keep}, 1, 0)",
    ]
    return f"aggregate(array_sort({found}), named_struct({start}), (a, d) -> named_struct({', '.join(step)}))"


def _count(text: Column) -> Column:
    """Number of words: the parts between separators, without the empty ones at the ends."""
    edge = [F.substring(text, at, 1).rlike(_SEPARATOR).cast("int") for at in (1, -1)]
    return F.when(text == "", 0).otherwise(F.size(F.split(text, _SEPARATOR + "+")) - edge[0] - edge[1])


@cache
def keywords() -> tuple[str, ...]:
    """The distinct keywords of all rules, and the base phrases: one of them stands in every text with a detection."""
    return tuple(dict.fromkeys([*(k for r in rules() for k in r[3].split("|")), *(f" {phrase} " for phrase in BASE)]))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words, n_base, first_word, last_word, base_labels, labels, score and n_found (surviving detections)."""
    table = ", ".join(
        f"struct({_quoted(label)} AS label, {-p} AS down, {w}D AS weight, split({_quoted(key)}, '[|]') AS keywords, {_quoted(expr)} AS pattern)" for label, p, w, key, expr in rules()
    )
    matched = _places("r.pattern", "__norm", ", 'down', r.down, 'label', r.label, 'weight', r.weight", _FOUND)
    found = f"flatten(transform(filter(array({table}), r -> exists(r.keywords, k -> array_contains(__keys, k))), r -> {matched}))"
    base = ", ".join(
        f"if(contains(__norm, ' {phrase} '), {_places(_quoted(f' {phrase}(?= )'), '__norm', f', {chr(39)}label{chr(39)}, {_quoted(label)}', 'struct<start:int,back:int,label:string>')}, NULL)"
        for phrase, label in BASE.items()
    )
    lowered = F.translate(F.col("__text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, _SEPARATOR, " ")), F.lit(" "))
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.select(*keep, _count(F.col("__text")).cast("long").alias("n_words"), norm.alias("__norm"))
    every = ", ".join(f"if(contains(__norm, {_quoted(k)}), {_quoted(k)}, NULL)" for k in keywords())
    rows = rows.select("*", F.expr(f"array_compact(array({every}))").alias("__keys"))
    rows = rows.select(
        *keep, "n_words", F.when(F.size("__keys") > 0, F.expr(_survivors(found))).alias("__kept"),
        F.when(F.size("__keys") > 0, F.expr(f"flatten(filter(array({base}), x -> x IS NOT NULL))")).alias("__base"),
    )
    base_labels = F.array_distinct(F.transform("__base", lambda b: b["label"]))
    empty = F.array().cast("array<string>")
    return rows.select(
        *keep, "n_words",
        F.when(F.col("__base").isNull(), F.lit(0)).otherwise(F.size("__base")).cast("long").alias("n_base"),
        F.array_min(F.transform("__base", lambda b: b["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("__base", lambda b: b["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce(base_labels, empty)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce(base_labels, empty), F.coalesce(F.col("__kept.labels"), empty))), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("__kept.score"), F.lit(0.0)), F.when(F.size("__base") > 0, F.lit(0.6)).otherwise(F.lit(0.0))).alias("score"),
        F.coalesce(F.col("__kept.n"), F.lit(0)).cast("long").alias("n_found"),
    )


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    return scan(table(spark, sf_dir, "documents"))
