"""License scans with built-in functions alone: signature rules behind a keyword prefilter.

A text becomes its words (A-Z lower-cased) with one space before, between and after them, so that a place
in it is a count of spaces. Rules are regular expressions over that form, ordered by kind.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: The phrases whose places are counted, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: A text without any of these, and without a grant (below), has no phrase and fits no rule.
GATE = ["licen", "copyright", "cc by", "cc0", "rights reserved", "general public", "public domain", "spdx", "creativecommons", "creative commons", "opensource org", "copyleft", "permission", "redistribution", "without warranty", "terms of", "eclipse org", "mozilla org", "sil org", "eupl", "wtfpl", "bsl11"]

#: How a grant without the word license begins. Only a text with one of the connections is searched for it.
CONNECTIONS = [" under ", " in accordance with ", " according to "]
GRANT = r"(?:released|distributed|available|published|provided)(?: to you)?(?: only)?(?:" + "|".join(CONNECTIONS) + ")"

#: label, keyword that the text must hold (one of several), the name as it is written, the SPDX identifier, the address (empty: no
#: rule of its own).
#: ``V`` stands for an optional word "version" or "v".
LICENSES = [
    ("apache-1.1", "apache", r"apache (?:software )?(?:licen[sc]e )?V1 1", "apache 1 1", r"apache org licenses license 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?(?:licen[sc]e )?V2(?: 0)?", "apache 2 0", r"apache org licenses license 2 0"),
    ("mit", "mit|expat", r"(?:mit|expat)(?: x11)?", "mit", r"opensource org licenses mit"),
    ("mit-0", "mit", r"mit no attribution", "mit 0", r"opensource org licenses mit 0"),
    ("isc", "isc", r"isc", "isc", r"opensource org licenses isc"),
    ("bsd-2-clause", "bsd", r"(?:2 clause|two clause|simplified|freebsd) bsd|bsd (?:2|two) clause", "bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:3 clause|three clause|new|modified|revised) bsd|bsd (?:3|three) clause", "bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:4 clause|four clause|original) bsd|bsd (?:4|four) clause", "bsd 4 clause", r"spdx org licenses bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero clause|0 clause) bsd|0bsd", "0bsd", r"opensource org licenses 0bsd"),
    ("bsd", "bsd", r"bsd(?: style)?", "bsd", r"linfo org bsdlicense"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e V1(?: 0)?", "gpl 1 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e V2(?: 0)?", "gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e V3(?: 0)?", "gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?V?2(?: 0)?|gplv2", "gpl 2 0(?: only| or later)?", r"gnu org licenses gpl2"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?V?3(?: 0)?|gplv3", "gpl 3 0(?: only| or later)?", r"gnu org licenses gpl3"),
    ("gpl", "general public|gpl", r"(?:gnu )?(?:general public|gpl)", "gpl", r"gnu org copyleft gpl"),
    ("lgpl-2.1", "lesser|library", r"(?:gnu )?(?:lesser|library) general public licen[sc]e V2 1", "lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e V3(?: 0)?", "lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "lgpl 2 0", r"gnu org copyleft lesser"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public(?: licen[sc]e)?(?: V3(?: 0)?)?", "agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: ?V?3(?: 0)?)?|agplv3", "agpl 3 0(?: only| or later)?", r"gnu org licenses agpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", "gfdl 1 [123](?: only| or later)?", r"gnu org licenses fdl"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e V1 1", "mpl 1 1", r"mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public(?: licen[sc]e V2(?: 0)?)?", "mpl 2 0", r"mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e V1(?: 0)?", "epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", r"eclipse public(?: licen[sc]e V2(?: 0)?)?", "epl 2 0", r"eclipse org legal epl 2 0"),
    ("mpl-1.1", "mpl", r"mpl ?V1 1", "", r"opensource org licenses mpl 1 1"),
    ("mpl-2.0", "mpl", r"mpl ?V2(?: 0)?", "", r"opensource org licenses mpl 2 0"),
    ("mpl", "mpl", r"mpl", "", ""),
    ("epl-1.0", "epl", r"epl ?V1(?: 0)?", "", r"opensource org licenses epl 1 0"),
    ("epl-2.0", "epl", r"epl ?V2(?: 0)?", "", r"opensource org licenses epl 2 0"),
    ("epl", "epl", r"epl", "", ""),
    ("eupl-1.2", "european union", r"european union public(?: licen[sc]e V1 2)?", "eupl 1 2", r"joinup ec europa eu (?:collection|software page) eupl"),
    ("cddl-1.0", "cddl|common development", r"cddl(?: V1 [01])?|common development and distribution", "cddl 1 [01]", r"opensource org licenses cddl 1 0"),
    ("artistic-2.0", "artistic", r"artistic(?: licen[sc]e V?2(?: 0)?)?", "artistic 2 0", r"opensource org licenses artistic license 2 0"),
    ("boost-1.0", "boost", r"boost software(?: licen[sc]e V1(?: 0)?)?", "bsl 1 0", r"boost org license 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib", r"opensource org licenses zlib"),
    ("unlicense", "unlicense", r"unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl|want to public", r"wtfpl|do what the fuck you want to public", "wtfpl", r"wtfpl net"),
    ("postgresql", "postgresql", r"postgresql", "postgresql", r"opensource org licenses postgresql"),
    ("python-2.0", "python|psf", r"python software foundation|psf", "python 2 0", r"docs python org license"),
    ("openssl", "openssl", r"openssl", "openssl", r"openssl org source license"),
    ("ofl-1.1", "font", r"(?:sil )?open font(?: licen[sc]e V1 1)?", "ofl 1 1", r"scripts sil org ofl"),
    ("odbl-1.0", "open database", r"open database(?: licen[sc]e V1(?: 0)?)?", "odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution", "odc by 1 0", r"opendatacommons org licenses by"),
    ("ms-pl", "microsoft", r"microsoft public", "ms pl", r"opensource org licenses ms pl"),
    ("busl-1.1", "business source", r"business source(?: licen[sc]e V1 1)?", "busl 1 1", r"mariadb com bsl11"),
    ("sspl-1.0", "server side", r"server side public(?: licen[sc]e V1)?", "sspl 1 0", r"mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", r"elastic(?: licen[sc]e V?2(?: 0)?)?", "elastic 2 0", r"elastic co licensing elastic license"),
    ("cc0-1.0", "cc0", r"cc0(?: V?1 0)?", "cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-3.0", "cc by", r"cc by V?3(?: 0)?", "cc by 3 0", r"creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "cc by", r"cc by V?4(?: 0)?", "cc by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", "cc by sa", r"cc by sa V?3(?: 0)?", "cc by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa", r"cc by sa V?4(?: 0)?", "cc by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nd-4.0", "cc by nd", r"cc by nd V?4(?: 0)?", "cc by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-3.0", "cc by nc", r"cc by nc V?3(?: 0)?", "cc by nc 3 0", r"creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-4.0", "cc by nc", r"cc by nc V?4(?: 0)?", "cc by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa V?4(?: 0)?", "cc by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd V?4(?: 0)?", "cc by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0"),
    ("cc-by-sa", "attribution share", r"creative commons attribution share ?alike", "cc by sa 2 0", r"creativecommons org licenses by sa"),
    ("cc-by-nc", "attribution non", r"creative commons attribution non ?commercial", "cc by nc 2 0", r"creativecommons org licenses by nc"),
    ("cc-by", "creative commons", r"creative commons attribution", "cc by 2 0", r"creativecommons org licenses by"),
    ("public-domain", "public domain", r"public domain(?: dedication)?", "pddl 1 0", r"creativecommons org publicdomain mark"),
    ("proprietary", "proprietary", r"proprietary(?: and confidential)?", "licenseref proprietary", r"proprietary license agreement"),
]

#: Kinds of rules, the strongest first: name, confidence, and the pattern around a license.
KINDS = [
    ("grant", 1.0, r"(?:licen[sc]ed|released|distributed|available|published|provided|dual licen[sc]ed|redistributed)(?: to you)?(?: only)? (?:under|in accordance with|according to)(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)? (?:NAME)(?: licen[sc]es?)?(?: V\d(?: \d)?)?"),
    ("identifier", 1.0, r"spdx licen[sc]e identifier (?:SPDX)"),
    ("address", 0.9, r"(?:https? )?(?:www )?(?:ADDRESS)"),
    ("field", 0.8, r"licen[sc](?:e|es|ing)(?: type| name| is| are)?(?: the)? (?:NAME)"),
    ("name", 0.7, r"(?:the )?(?:NAME)(?: public| software)? licen[sc]e"),
]

#: Rules that no license's name is in.
NOTICES = [
    ("reserved", "rights reserved", "grant", r"(?:all|some|no) rights reserved"),
    ("copyright", "copyright", "name", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", "copyright", "field", r"copyright (?:notice|holder|holders|owner|owners)"),
    ("permissive-text", "permission is hereby", "grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("permissive-text", "redistribution and use", "grant", r"redistribution and use in source and binary forms with or without modification"),
    ("permissive-text", "permission to use", "grant", r"permission to use copy modify and or distribute this software"),
    ("no-warranty", "without warranty", "field", r"without warranty of any kind(?: express or implied)?"),
    ("copyleft", "copyleft", "name", r"copyleft"),
    ("public-domain", "public domain", "grant", r"(?:placed|dedicated|released|is) (?:in|into|to) the public domain"),
    ("terms", "terms of", "name", r"(?:licen[sc]e )?terms of (?:use|service)"),
]


def surely(pattern: str) -> str:
    """``pattern`` without the groups that may be missing from a match."""
    before = None
    while pattern != before:
        before, pattern = pattern, re.sub(r"\((?:\?:)?[^()]*\)\?", "", pattern)
    return pattern


def rules() -> dict[str, list[dict]]:
    """All rules by keyword: label, kind (0 the strongest), rank (of equal kinds the first stays: exact
    versions stand before families), confidence and pattern."""
    names = [k for k, *_ in KINDS]
    found: dict[str, list[dict]] = {}
    for rank, (label, keyword, name, spdx, address) in enumerate(LICENSES):
        for k, (kind, confidence, around) in enumerate(KINDS):
            if not {"identifier": spdx, "address": address}.get(kind, name):
                continue
            if kind == "name" and "licen" in surely(name):  # the word is in the name
                around = "(?:the )?(?:NAME)(?: licen[sc]e)?"
            pattern = around.replace("NAME", name).replace("SPDX", spdx).replace("ADDRESS", address).replace("V", r"(?:v|v |version )?")
            rule = {"label": label, "kind": k, "rank": rank, "confidence": confidence, "pattern": f"(?<= )(?:{pattern})(?= )"}
            for word in {"identifier": ["spdx"], "address": [address.split(" ")[0]]}.get(kind, keyword.split("|")):
                found.setdefault(word, []).append(rule)
    for label, keyword, kind, pattern in NOTICES:
        k = names.index(kind)
        found.setdefault(keyword, []).append({"label": label, "kind": k, "rank": len(LICENSES), "confidence": KINDS[k][1], "pattern": f"(?<= )(?:{pattern})(?= )"})
    return found


def _spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


#: Steps of a running sum over arrays: more than a text can have words.
_STEPS = [1 << k for k in range(30)]


def _running(values: Column, finish) -> Column:
    """``finish`` of the running sums of an array: each step adds what stands twice as far back as the last one
    did, so that n values take n log n additions, and no array grows by one value at a time."""

    def step(sums: Column, back: Column) -> Column:
        return F.when(F.size(sums) > back, F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(0))).otherwise(sums)

    return F.aggregate(F.array(*map(F.lit, _STEPS)), values, step, finish)


_PIECES = "array<struct<pieces:array<string>,rule:int>>"


def _pieces(norm: Column) -> tuple[Column, list[dict]]:
    """Where rules whose keyword occurs match: the text in pieces, of which every second one is a match, by place of the rule in the list beside it. Patterns are
    literals, so that each is compiled once."""
    table, found, listed = rules(), [], []
    keywords: dict[tuple[int, str], list[str]] = {}
    families: dict[tuple[str, ...], list[dict]] = {}
    for keyword, of in table.items():
        for rule in of:
            keywords.setdefault((rule["rank"], rule["pattern"]), []).append(keyword)
    for keyword, of in table.items():
        for rule in of:
            some = keywords[rule["rank"], rule["pattern"]]
            if keyword == some[0]:
                families.setdefault(tuple(some), []).append(rule)
    none = F.expr(f"cast(array() as {_PIECES})")
    for some, of in sorted(families.items()):
        present, cut = F.lit(False), []
        for keyword in some:
            present = present | F.contains(norm, F.lit(keyword))
        for rule in of:
            pieces = F.split(F.regexp_replace(norm, rule["pattern"], "\u0001$0\u0001"), "\u0001", -1)
            cut.append(F.when(F.rlike(norm, F.lit(rule["pattern"])), F.struct(pieces.alias("pieces"), F.lit(len(listed)).alias("rule"))))
            listed.append(rule)
        found.append(F.when(present, F.array_compact(F.array(*cut))).otherwise(none))
    return F.flatten(F.array(*found)), listed


def _detections(norm: Column) -> Column:
    """(start, -end, kind, rank, label, confidence), sorted, of all places of all rules; places are characters."""
    cut, listed = _pieces(norm)
    fixed = F.from_json(F.lit(json.dumps([{k: rule[k] for k in ("kind", "rank", "label", "confidence")} for rule in listed])), "array<struct<kind:int,rank:int,label:string,confidence:double>>")

    def of_rule(match: Column) -> Column:
        rule = F.get(fixed, match["rule"])

        def spans(ends: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(ends) - 2, F.lit(2)), lambda i: F.struct(F.get(ends, i - 1).alias("start"), (-F.get(ends, i)).alias("minus_end"), *(rule[k].alias(k) for k in ("kind", "rank", "label", "confidence"))))

        return _running(F.transform(match["pieces"], F.length), spans)

    return F.array_sort(F.flatten(F.transform(cut, of_rule)))


def _surviving(detections: Column) -> Column:
    """Labels and best confidence of what survives, from one sweep over the sorted detections.

    Containment first: what lies within another detection goes (of equal places the stronger kind stays, then
    the rule that stands first). Then priority: of what is left, a detection that overlaps one of a stronger
    kind goes, whichever begins first. ``open`` has those that later ones may still overlap: few, as none of them
    contains another.
    """
    none = F.struct(
        F.lit(-1).alias("end"), F.expr("cast(array() as array<struct<end:int,kind:int,label:string,confidence:double,lost:boolean>>)").alias("open"),
        F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score"),
    )

    def settled(done: Column, over: Column) -> list[Column]:
        labels = F.when(F.size(over) > 0, F.array_union(done["labels"], F.transform(over, lambda p: p["label"]))).otherwise(done["labels"])
        return [labels.alias("labels"), F.greatest(done["score"], F.coalesce(F.array_max(F.transform(over, lambda p: p["confidence"])), F.lit(0.0))).alias("score")]

    def step(done: Column, d: Column) -> Column:
        over = F.filter(done["open"], lambda p: (p["end"] <= d["start"]) & ~p["lost"])
        near = F.filter(done["open"], lambda p: p["end"] > d["start"])
        lost = F.exists(near, lambda p: p["kind"] < d["kind"])
        own = F.struct((-d["minus_end"]).alias("end"), d["kind"].alias("kind"), d["label"].alias("label"), d["confidence"].alias("confidence"), lost.alias("lost"))
        near = F.transform(near, lambda p: F.struct(p["end"].alias("end"), p["kind"].alias("kind"), p["label"].alias("label"), p["confidence"].alias("confidence"), (p["lost"] | (d["kind"] < p["kind"])).alias("lost")))
        return F.when(-d["minus_end"] <= done["end"], done).otherwise(F.struct((-d["minus_end"]).alias("end"), F.concat(near, F.array(own)).alias("open"), *settled(done, over)))

    return F.aggregate(detections, none, step, lambda done: F.struct(*settled(done, F.filter(done["open"], lambda p: ~p["lost"]))))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row of ``docs``.

    ``n_base``: places where the words of a phrase of ``PHRASES`` stand side by side, and the smallest and
    largest start of one, in words (null without any). ``labels``: those of the phrases and of the rules'
    surviving detections (see ``_surviving``), distinct, sorted, comma-joined (empty: none). ``score``: the confidence of the
    best detection, at least 0.5 with a phrase, else 0. Null and empty texts have no words; very long ones take
    time in proportion to their length (but for a logarithm of the number of matches); repeated rows
    are each scanned, an empty table gives no rows; other columns are not read. Everything happens within a row: no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.trim(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _BETWEEN, " ")).alias("words"))
    rows = rows.withColumn("n_words", F.when(F.col("words") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("words")) + 1))
    # lower() also maps letters beyond ASCII, so it lets through more texts than the exact form, never fewer
    lowered = F.lower("words")
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(lowered, F.lit(word))
    connected = F.lit(False)
    for word in CONNECTIONS:
        connected = connected | F.contains(lowered, F.lit(word))
    gate = gate | (connected & F.rlike(lowered, F.lit(GRANT)))
    rows = rows.withColumn("norm", F.when(gate, F.concat(F.lit(" "), F.translate("words", _UPPER, _LOWER), F.lit(" "))))
    rows = rows.select("id", "n_words", "norm")

    norm, present = F.col("norm"), F.col("norm").isNotNull()
    base = []
    for phrase, label in PHRASES:
        rest = F.split(norm, f"(?<= ){phrase}(?= )", -1)
        last = F.col("n_words") - (phrase.count(" ") + 1) + 1 - _spaces(F.element_at(rest, -1))
        base.append(F.struct((F.size(rest) - 1).cast("long").alias("n"), (_spaces(rest[0]) - 1).alias("first"), last.alias("last"), F.lit(label).alias("label")))
    found = F.filter(F.array(*base), lambda b: b["n"] > 0)
    rows = rows.withColumn("base", F.when(present, found))
    rows = rows.withColumn("more", F.when(present, _surviving(_detections(norm)))).drop("norm")

    nothing = F.expr("cast(array() as array<string>)")
    named = F.coalesce(F.transform("base", lambda b: b["label"]), nothing)
    return rows.select(
        F.col("id").alias(id_col), "n_words",
        F.coalesce(F.aggregate("base", F.lit(0).cast("long"), lambda n, b: n + b["n"]), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(named), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, F.coalesce("more.labels", nothing))), ",").alias("labels"),
        F.greatest(F.coalesce("more.score", F.lit(0.0)), F.when(F.size(named) > 0, 0.5).otherwise(0.0)).alias("score"),
    )
