"""Licence scans by sentence rules.

A text that may speak of licences is cut into sentences (wrapped lines are joined first, comment signs
fall away) and every sentence is normalised. A whole normalised sentence is mapped to identifiers: a
sentence of a known licence text, a notice that puts something under licences it names, a title that is
a licence's name and nothing else, or an SPDX expression. A sentence that denies is no notice. The
sequence of a text's identifiers is then matched against licence rules in order; what a rule matches
it takes out, so a longer rule comes before a shorter one. Sentences that speak of licences without
being known are counted.

All of it is column expressions within a row: no shuffle, no Python.

Cases: null or empty text: no licences; a text that only mentions licences: status ``unknown`` with its
sentences counted; texts of any length: whole; repeated sentences: a rule may match more than once, the
licence is listed once; ties: licences are listed in order of their names; repeated rows: each gets its
own result; empty table: no rows; extra columns, whatever their names: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words without one of which a text isn't looked at, and a sentence doesn't speak of licences. Fixed values.
MENTION = (
    r"licen[sc]|copyright|warrant|redistribut|permission (?:is|to)|public domain|spdx|[\"'“‘]as[ -]is|creative commons|\bcc[ -]by|\bcc0|general public|\bgpl|\bbsd|neither the name|misrepresented|altered source"
    r"|unencumbered|python software foundation"
)

#: Names of licences as notices give them: licence, pattern of the name. {v} stands for "version", "v" and the like. Fixed values.
NAMES = (
    ("MIT", r"(?:mit|expat)(?:/x11)?(?:[ -]style)?(?: licen[sc]e| terms)?\b"),
    ("Apache-2.0", r"apache(?: software)?(?: licen[sc]e)?,? ?{v}2(?:\.0)?\b(?!\.\d)"),
    ("Apache-1.1", r"apache software licen[sc]e,? ?{v}1\.1\b"),
    ("AGPL-3.0", r"(?:gnu affero general public licen[sc]e|\bagpl)[^.;]{0,80}?{v}3(?:\.0)?\b"),
    ("LGPL-2.1", r"(?:gnu (?:lesser|library) general public licen[sc]e|\blgpl)[^.]{0,80}?{v}2\.1\b"),
    ("LGPL-3.0", r"(?:gnu lesser general public licen[sc]e|\blgpl)[^.]{0,80}?{v}3(?:\.0)?\b"),
    ("LGPL-2.0", r"(?:gnu (?:lesser|library) general public licen[sc]e|\blgpl)[^.]{0,80}?{v}2(?:\.0)?\b(?!\.1)"),
    ("GPL-2.0", r"(?:gnu general public licen[sc]e|\b(?:gnu )?gpl)[^.]{0,80}?{v}2(?:\.0)?\b(?!\.1)"),
    ("GPL-3.0", r"(?:gnu general public licen[sc]e|\b(?:gnu )?gpl)[^.]{0,80}?{v}3(?:\.0)?\b"),
    ("BSD-3-Clause", r"(?:bsd[ -](?:3|three)[ -]clause|(?:3|three)[ -]clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?"),
    ("BSD-2-Clause", r"(?:bsd[ -](?:2|two)[ -]clause|(?:2|two)[ -]clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("0BSD", r"(?:\b0bsd\b|bsd zero[ -]clause|zero[ -]clause bsd)(?: licen[sc]e)?"),
    ("ISC", r"\bisc(?: licen[sc]e)?\b"),
    ("MPL-2.0", r"mozilla public licen[sc]e,? ?{v}2(?:\.0)?\b"),
    ("MPL-1.1", r"mozilla public licen[sc]e,? ?{v}1\.1\b"),
    ("EPL-2.0", r"eclipse public licen[sc]e,? ?(?:- )?{v}2(?:\.0)?\b"),
    ("EPL-1.0", r"eclipse public licen[sc]e,? ?(?:- )?{v}1(?:\.0)?\b"),
    ("CDDL-1.0", r"common development and distribution licen[sc]e[^.]{0,12}?{v}1(?:\.0)?\b"),
    ("Artistic-2.0", r"artistic licen[sc]e,? ?{v}2(?:\.0)?\b"),
    ("Zlib", r"\bzlib(?:/libpng)?(?: licen[sc]e)?\b"),
    ("BSL-1.0", r"boost software licen[sc]e(?:,? ?-? ?{v}1(?:\.0)?\b)?"),
    ("Unlicense", r"\bunlicense\b"),
    ("WTFPL", r"\bwtfpl\b|do what the fuck you want to public licen[sc]e"),
    ("PSF-2.0", r"python software foundation licen[sc]e(?:,? ?{v}2)?"),
    ("CC0-1.0", r"\bcc0(?:[ -]1\.0)?(?: universal)?|public domain dedication"),
)
#: Kinds of Creative Commons licences: suffix, pattern of it after "by" in letters and in words; and versions. Fixed values.
COMMONS = (("-NC-SA", "-nc-sa", "-noncommercial-sharealike"), ("-NC-ND", "-nc-nd", "-noncommercial-noderiv(?:ative)?s?"), ("-NC", "-nc(?!-)", "-noncommercial(?!-)"), ("-SA", "-sa", "-sharealike"), ("-ND", "-nd", "-noderiv(?:ative)?s?"), ("", "(?!-)", "(?!-)"))
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Names without a version, which count where none with a version is found. Fixed values.
PLAIN_NAMES = (
    ("AGPL", r"gnu affero general public licen[sc]e|\bagpl\b"), ("LGPL", r"gnu (?:lesser|library) general public licen[sc]e|\blgpl\b"), ("GPL", r"gnu general public licen[sc]e|\bgpl\b"),
    ("Apache", r"apache(?: software)? licen[sc]e"), ("MPL", r"mozilla public licen[sc]e"), ("EPL", r"eclipse public licen[sc]e"), ("Artistic", r"artistic licen[sc]e"), ("BSD", r"\bbsd licen[sc]e"), ("CDDL", r"common development and distribution licen[sc]e"),
)
VERSION = r"(?:\(?(?:either )?(?:version |ver\.? ?|v\.? ?|-)?)"

#: Sentences of licence texts: identifier, pattern from a sentence's beginning on. Fixed values.
SENTENCES = (
    ("mit_grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files|permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included"),
    ("isc_grant", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that"),
    ("bsd0_grant", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted$"),
    ("isc_grant", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    ("apache_duty", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache_copy", r"you may obtain a copy of the licen[sc]e at"),
    ("bsd_grant", r"redistribution and use in source and binary forms"),
    ("bsd_source", r"(?:\(?\w[.)] |[-*] )?redistributions of source code must retain the above copyright"),
    ("bsd_binary", r"(?:\(?\w[.)] |[-*] )?redistributions in binary form must reproduce the above copyright"),
    ("bsd_name", r"(?:\(?\w[.)] |[-*] )?neither the name of"),
    ("zlib_origin", r"(?:\(?\w[.)] )?the origin of this software must not be misrepresented"),
    ("zlib_altered", r"(?:\(?\w[.)] )?altered source versions must be plainly marked as such"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("gpl_more", r"(?:see the gnu (?:lesser |library |affero )?general public licen[sc]e for more details|you should have received a copy of the gnu)"),
    ("rights", r"all rights reserved$"),
    ("copyright", r"(?:©|\(c\)|copyright)[^a-z]{0,8}.*\d{4}"),
    ("as_is", r".*provided (?:by .{0,80})?[\"'“‘]?as[ -]is"),
    ("warranty", r"(?:this|the) .{0,40}(?:is|are) distributed .{0,80}without (?:any )?warrant"),
)
#: How a notice puts something under a licence, and what denies it. Fixed values.
NOTICE = (
    r"^(?:[^.]{0,160}\b)?(?:licen[sc]ed(?: to you)?|released|distributed|available|provided|covered|published|redistribute(?: it)?(?: and/or modify(?: it)?)?|modify it|governed|offered|used|usable|dual[ -]licen[sc]ed|subject)"
    r"(?: \w+){0,4} (?:under|by|to|with)\b"
)
DENIAL = (
    r"\b(?:not|never|no longer|cannot|nor|neither|isn't|aren't|wasn't|unlike|instead of|rather than|formerly|previously)\b[^.;]*"
    r"\b(?:licen[sc]ed|released|distributed|available|provided|covered|published|governed|offered)\b"
)
#: What a title or a label may have beside a name. Fixed values.
TITLE = r"^(?:the |code: |licen[sc]e: ?|a |this (?:work|project|software) uses the )?(?:{name})(?:[ ,-]*(?:licen[sc]e|international|universal|unported|work|only|or later|{version}\d(?:\.\d)*))*$"

#: SPDX identifiers (without -only and -or-later), which stand for themselves. Fixed values.
SPDX = tuple(
    "MIT Apache-2.0 Apache-1.1 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 BSD-2-Clause BSD-3-Clause 0BSD ISC MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 Artistic-2.0 Zlib BSL-1.0 Unlicense WTFPL PSF-2.0 CC0-1.0".split()
) + tuple(f"CC-BY{k}-{v}" for k, _, _ in COMMONS for v in COMMONS_VERSIONS)

#: Licence rules over identifiers of texts in order: licence, and the pattern of identifiers, each between < and >. Fixed values.
RULES = (
    ("MIT", r"<mit_grant>(?:<mit_notice>)?(?:<as_is>)?"),
    ("BSD-3-Clause", r"<bsd_grant>(?:<bsd_source>)?(?:<bsd_binary>)?<bsd_name>(?:<as_is>)?"),
    ("BSD-2-Clause", r"<bsd_grant>(?:<bsd_source>)?(?:<bsd_binary>)?(?:<as_is>)?"),
    ("0BSD", r"<bsd0_grant>(?:<as_is>)?"),
    ("ISC", r"<isc_grant>(?:<as_is>)?"),
    ("Zlib", r"<zlib_origin>(?:<zlib_altered>)?"),
    ("Unlicense", r"<unlicense>"),
    ("Apache-2.0", r"<Apache-2.0>(?:<apache_duty>)?(?:<apache_copy>)?"),
    ("Apache-2.0", r"<apache_duty>(?:<apache_copy>)?"),
)

#: A wrapped line goes on with a small letter, or ends with a word that asks for more. Fixed values.
WRAPS = (
    (r"(?<![.!?:\s])[ \t\r]*\n[ \t\r/*#;%-]*(?=[a-z0-9(])", " "),
    (r"(?i)\b(the|gnu|general|public|lesser|affero|library|apache|mozilla|eclipse|software|creative|commons|either|version|of|or|and|a|by|under|to|new)[ \t\r]*\n[ \t\r/*#;%-]*(?=\S)", "$1 "),
    (r"(?i)\bv(?:er)?\. (?=\d)", "version "),
)
#: A sentence ends after a mark that a blank follows, and at a line's end. Fixed value.
SENTENCE_END = r"[.!?]?[ \t\r]*\n[\s/*#;%-]*|[.!?] +"
#: What normalising takes off: marks and comment signs around a sentence. Fixed value.
TRIM = r"^[\s/*#;%=-]+|[\s*/.!?;,:=-]+$"


def names() -> list[tuple[str, str]]:
    """Licences with the patterns of their names, those with a version before those without."""
    out = [(n, p.replace("{v}", VERSION)) for n, p in NAMES]
    for kind, letters, words in COMMONS:
        name = rf"(?:\bcc[ -]by{letters}|creative commons attribution{words})"
        out += [(f"CC-BY{kind}-{v}", rf"{name}(?: licen[sc]e)?,? ?{VERSION}{v.replace('.', '[.]')}") for v in COMMONS_VERSIONS]
        out.append((f"CC-BY{kind}", rf"{name}(?!(?: licen[sc]e)?,? ?{VERSION}\d)"))
    return out


def sentences(text: Column) -> Column:
    """Normalised sentences of a text that speak of licences."""
    whole = text
    for pattern, instead in WRAPS:
        whole = F.regexp_replace(whole, pattern, instead)
    # texts without any such word, which are most, aren't cut at all
    cut = F.when(F.lower(text).rlike(MENTION), F.split(whole, SENTENCE_END)).otherwise(F.array().cast("array<string>"))
    plain = F.transform(cut, lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), TRIM, ""), r"\s+", " "))
    return F.filter(plain, lambda s: s.rlike(MENTION))


def identifiers(sentence: Column) -> Column:
    """Identifiers of a sentence in order of the tables; ``unknown`` alone if it has none."""
    spdx = F.regexp_extract(sentence, r"^spdx-license-identifier: ?(.+)$", 1)
    known = F.create_map(*(F.lit(x) for n in SPDX for x in (n.lower(), n)))
    parts = F.transform(F.split(F.regexp_replace(spdx, r"[()]", " "), r"\s+(?:and|or|with)\s+"), lambda x: F.element_at(known, F.regexp_replace(F.trim(x), r"(?:-only|-or-later|\+)$", "")))
    text = None
    for name, pattern in SENTENCES:
        hit = sentence.rlike(f"^(?:{pattern})")
        text = F.when(hit, F.lit(name)) if text is None else text.when(hit, F.lit(name))
    every = names()
    notice = sentence.rlike(NOTICE) & ~sentence.rlike(DENIAL)
    title = sentence.rlike(TITLE.replace("{version}", VERSION).replace("{name}", "|".join(p for _, p in [*every, *PLAIN_NAMES])))
    versioned = F.array_compact(F.array(*(F.when(sentence.rlike(p), F.lit(n)) for n, p in every)))
    plain = F.array_compact(F.array(*(F.when(sentence.rlike(p), F.lit(n)) for n, p in PLAIN_NAMES)))
    named = F.when(notice | title, F.when(F.size(versioned) > 0, versioned).otherwise(plain)).otherwise(F.array().cast("array<string>"))
    found = F.when(spdx != "", F.array_compact(parts)).when(text.isNotNull(), F.array(text)).otherwise(named)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, licences (sorted, one string), n_sentences, n_known, n_unknown, status of every text."""
    by_sentence = F.transform(sentences(F.coalesce(F.col("text"), F.lit(""))), identifiers)
    rows = docs.select("doc_id", by_sentence.alias("found")).withColumn("ids", F.flatten("found"))
    # what is said of a licence's whereabouts belongs to the notice before it
    rest = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    out = rows.withColumn("rest", F.when(F.size("ids") == 0, F.lit("")).otherwise(F.regexp_replace(rest, r"(?:<unknown>)*<gpl_more>", "")))
    for i, (_, pattern) in enumerate(RULES):
        hit = F.col("rest").rlike(pattern)
        # what a rule took out leaves a mark, so that its neighbours don't become neighbours of each other
        out = out.withColumn(f"hit{i}", hit).withColumn("rest", F.when(hit, F.regexp_replace("rest", pattern, "-")).otherwise(F.col("rest")))
    # then every name stands for itself
    names_left = F.filter(F.regexp_extract_all("rest", F.lit("<([^<>]+)>"), F.lit(1)), lambda x: x.isin(*sorted({n for n, _ in [*names(), *PLAIN_NAMES]} | set(SPDX))))
    by_rule = F.array_compact(F.array(*(F.when(F.col(f"hit{i}"), F.lit(name)) for i, (name, _) in enumerate(RULES))))
    out = out.withColumn("licences", F.array_sort(F.array_distinct(F.concat(by_rule, names_left))))
    unknown = F.size(F.filter("found", lambda x: F.array_contains(x, "unknown")))
    return out.select(
        "doc_id",
        F.array_join("licences", ",").alias("licences"),
        F.size("found").cast("long").alias("n_sentences"),
        (F.size("found") - unknown).cast("long").alias("n_known"),
        unknown.cast("long").alias("n_unknown"),
        F.when(F.size("licences") > 0, "known").when(F.size("found") > 0, "unknown").otherwise("none").alias("status"),
    )


def scan_sql() -> str:
    """The scan of the documents table in DuckDB, from the four notices that it holds rather than from
    the tables above: a sentence is one of them, or it isn't known."""
    return """WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
 sentences AS (SELECT doc_id, lower(rtrim(trim(unnest(string_split_regex(line, '[.!?] +'))), '.!?;,: ')) AS s FROM lines),
 named AS (SELECT doc_id, CASE s WHEN 'released under the mit license' THEN 'MIT' WHEN 'licensed under the apache license, version 2.0' THEN 'Apache-2.0'
   WHEN 'this work is licensed under the gnu general public license, version 3' THEN 'GPL-3.0' WHEN 'licensed under cc by-nc 4.0' THEN 'CC-BY-NC-4.0' END AS licence
   FROM sentences WHERE contains(s, 'licens') OR contains(s, 'licenc') OR contains(s, 'copyright') OR contains(s, 'general public')),
 counted AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) AS n, count(licence) AS k FROM named GROUP BY doc_id)
 SELECT d.doc_id, coalesce(licences, '') AS licences, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(k, 0) AS BIGINT) AS n_known, CAST(coalesce(n - k, 0) AS BIGINT) AS n_unknown,
   CASE WHEN k > 0 THEN 'known' WHEN n > 0 THEN 'unknown' ELSE 'none' END AS status FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id"""
