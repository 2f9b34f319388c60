"""License scans by sentences and rules, in DataFrame functions only.

A text is cut into sentences (at . ! ? before white space and at blank lines; a single line break doesn't end one). Sentences
are normalised: comment marks and punctuation become single spaces, A-Z lower case. Each known license sentence, a pattern of
SENTENCES, stands for an id of one character; a sentence gives the ids of all known ones in it, and an "u" if license words
are left over. The ids of a document in order are matched by RULES, the first that fits at a place; ids that no rule takes
give UNKNOWN, so no sentence with a license word is passed over. Copyright lines have an id, but are no license.

Scale. One pass, no shuffle; only texts and sentences with one of the words of GATE, without which no pattern fits, are cut
and normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .secrets import matches, prefix_sums

END = "(?<=[.!?])(?<!\\b[vV]\\.)(?<!\\b[vV]er\\.)\\s+|\\n[^\\S\\n]*\\n\\s*"
#: Every pattern of SENTENCES and LEFT holds one of these.
GATE = "(?i)licen|lizen|copyright|copyleft|warrant|liab|permi|redistribut|gpl|(?<![a-z0-9])(?:cc|mpl)|creative|domain|reserved|endorse|advertis|gemeinfrei"
LEFT = "licen[sc]|lizen[sz]|copyleft|redistribut|permission is|gemeinfrei|public domain"

_LEAD = "(?:(?:(?:this|the) (?:work|program|software|file|text|document|library|project) (?:is|are) )?(?:dual-?)?(?:licensed|released|distributed|available|published|provided) (?:under|subject to) )?(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
_FREE = "(?:this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the )?"
_VERSION = "(?:version|ver\\.?|v\\.?) ?([0-9]+(?:\\.[0-9]+)*)"
_TAIL = "(?: the licen[sc]e)?"
_LATER = "( of the licen[sc]e)?(?: only)?((?: or)?(?: at your option)? any later version| or later)?"
_GNU = "(?:either )?(?:as published by the free software foundation )?(?:either )?"


def _gpl(middle: str, short: str) -> str:
    """A GNU license by its name or short form. Groups: versions behind either, whether later ones are meant."""
    return f"{_FREE}{_LEAD}(?:(?:gnu )?{middle}general public licen[sc]e(?: {short})?(?: {_GNU}{_VERSION}{_LATER})?|(?:gnu )?{short}(?:(?:-| ?v| ?version )?([0-9](?:\\.[0-9])?)(\\+|-or-later| or later| or any later version)?)?(?:-only)?(?: licen[sc]e)?){_TAIL}"


#: id: (name, pattern in normalised text; its groups are read by _detail). Of two that fit at one place, the first in ORDER.
SENTENCES = {
    # grants and notices that name a license
    "x": ("spdx", "spdx-license-identifier ([a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*)"),
    "r": ("gpl copy", "you should have received a copy of the gnu (?:(?:lesser|library|affero) )?general public licen[sc]e(?: along with this (?:program|library|file|software))?"),
    "a": ("AGPL", _gpl("affero ", "agpl")),
    "l": ("LGPL", _gpl("(?:lesser|library) ", "lgpl")),
    "g": ("GPL", _gpl("", "gpl")),
    "p": ("Apache", f"{_LEAD}(?:apache(?: software)? licen[sc]e(?: {_VERSION}| ([0-9]\\.[0-9]))?|apache-([0-9]\\.[0-9])(?: licen[sc]e)?){_TAIL}"),
    "c": ("CC", f"{_LEAD}(?:a )?(?:creative commons |cc[ -])(?:cc[ -])?(by(?:[ -](?:nc|sa|nd))*|attribution(?:[ -](?:non-?commercial|share-?alike|no-?deriv(?:ative)?s?))*)(?:[ -]([0-9]\\.[0-9]))?(?: (?:international|unported|generic))?(?: (?:public )?licen[sc]e)?"),
    "C": ("CC link", "(?:https? )?(?:www\\.)?creativecommons\\.org licenses (by(?:-(?:nc|sa|nd))*) ([0-9]\\.[0-9])"),
    "0": ("CC0", f"{_LEAD}(?:a )?(?:creative commons (?:zero|cc0)|cc0)(?:[ -][0-9]\\.[0-9])?(?: universal)?(?: (?:public domain dedication|licen[sc]e))?"),
    "m": ("MIT", f"{_LEAD}(?:mit|expat|mit expat)[ -]licen[sc]ed?"),
    "b": ("BSD", f"{_LEAD}(?:([234])-clause )?bsd(?:[ -]([234])-clause)?(?:-style)?[ -]licen[sc]ed?"),
    "i": ("ISC", f"{_LEAD}isc licen[sc]e"),
    "o": ("MPL", f"(?:this source code form is subject to the terms of the )?{_LEAD}mozilla public licen[sc]e(?: {_VERSION}| ([0-9]\\.[0-9]))?"),
    "O": ("mpl copy", "if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:mozilla\\.org mpl [0-9.]+)?"),
    "e": ("EPL", f"{_LEAD}eclipse public licen[sc]e(?: -)?(?: {_VERSION}| ([0-9]\\.[0-9]))?"),
    "s": ("BSL", f"{_LEAD}boost software licen[sc]e(?: -)?(?: {_VERSION}| ([0-9]\\.[0-9]))?"),
    "z": ("Zlib", f"{_LEAD}zlib(?: libpng)? licen[sc]e"),
    "n": ("Unlicense", f"{_LEAD}unlicense"),
    "w": ("WTFPL", f"{_LEAD}do what the fuck you want to public licen[sc]e"),
    "d": ("public domain", "(?:this is free and unencumbered software )?(?:(?:released|dedicated|placed) (?:in)?to the|(?:is|are) in the|in the) public domain"),
    # sentences of license texts
    "G": ("mit grant", "permission is hereby granted free of charge to any person obtaining a copy of this software(?:.{0,400}furnished to do so)?"),
    "N": ("mit notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    "W": ("as is", "(?:the|this) software is provided as[ -]is without (?:warranty of any kind|any express or implied warranty)|this software is provided by the copyright holders and contributors as is"),
    "L": ("liability", "in no event (?:shall|will) the (?:authors?|copyright holders?|copyright owner)[a-z ]* be (?:held )?liable"),
    "H": ("bsd head", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    "S": ("bsd source", "redistributions of source code must retain the above copyright notice"),
    "B": ("bsd binary", "redistributions in binary form must reproduce the above copyright notice"),
    "A": ("bsd advertising", "all advertising materials mentioning features or use of this software must display"),
    "E": ("bsd endorsement", "neither the names? of .{1,200}? may be used to endorse or promote products|the names? of .{1,200}? may not be used to endorse or promote products"),
    "I": ("isc grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "Z": ("zlib grant", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    "P": ("apache compliance", "you may not use this file except in compliance with the licen[sc]e"),
    "T": ("apache copy", "you may obtain a copy of the licen[sc]e at"),
    "t": ("apache link", "(?:https? )?(?:www\\.)?apache\\.org licenses license-([0-9.]*[0-9])"),
    "y": ("gnu link", "(?:https? )?(?:www\\.)?gnu\\.org licenses(?: [a-z0-9.-]+)?"),
    "D": ("apache as is", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    "F": ("apache limits", "see the licen[sc]e for the specific language governing permissions and limitations(?: under the licen[sc]e)?"),
    "V": ("gpl warranty", "(?:it|this (?:program|library)|[a-z]+) is distributed in the hope that it will be useful but without any warranty"),
    "M": ("gpl details", "see the gnu (?:(?:lesser|library|affero) )?general public licen[sc]e for more details"),
    "R": ("reserved", "all rights reserved"),
    "K": ("copyright", "copyright (?:c |© )?[0-9]{4}"),
}
#: r, M and y are before the licenses whose names they hold.
ORDER = "xrMy" + "".join(k for k in SENTENCES if k not in "xrMy")
KNOWN = {k: SENTENCES[k][1] for k in ORDER}

#: (pattern over ids without R and K, license); None: as the first sentence says, with its version.
RULES = (
    ("m?GN?W?L?", "MIT"),
    ("b?HS?B?A[EB]?WL?|b?HS?B?AE?", "BSD-4-Clause"),
    ("b?HS?B?EW?L?", "BSD-3-Clause"),
    ("b?HS?BW?L?", "BSD-2-Clause"),
    ("i?IW?L?", "ISC"),
    ("z?WL?Z|z?ZW?L?", "Zlib"),
    ("n?d?n", "Unlicense"),
    ("[agl]V?M?r?y?", None),
    ("pP?T?t?D?F?", None),
    ("cC?", None),
    ("oO?", None),
    ("[xCbes]", None),
    ("m", "MIT"),
    ("i", "ISC"),
    ("z", "Zlib"),
    ("w", "WTFPL"),
    ("0", "CC0-1.0"),
    ("d", "public domain"),
    (".", "UNKNOWN"),
)


def normal(col: Column) -> Column:
    """The sentence without comment marks and punctuation, white space as single spaces, A-Z in lower case."""
    spaced = F.regexp_replace(col, "[\\s,;:()\\[\\]{}\"'“”„‘’`/*#<>!?|=_]+|\\.(?=[\\s)\\]\"'>/]|$)|(?:^|(?<=\\n))[^\\S\\n]*-+[^\\S\\n]", " ")
    return F.trim(F.regexp_replace(C.ascii_lower(spaced), " +", " "))


def _whole(pattern: str) -> str:
    return f"(?<![a-z0-9])(?:{pattern})(?![a-z0-9])"


ANY = _whole("|".join(f"(?:{p})" for p in KNOWN.values()))


def _id(part: Column) -> Column:
    out = F.lit("u")
    for k, pattern in reversed(KNOWN.items()):
        out = F.when(part.rlike(f"^(?:{pattern})$"), F.lit(k)).otherwise(out)
    return out


def _detail(id_: Column, part: Column) -> Column:
    """The license's name with its version, of the sentence that names it."""
    group = lambda k, n: F.regexp_extract(part, f"^(?:{KNOWN[k]})$", n)
    with_version = lambda name, version: F.when(version == "", F.lit(name)).otherwise(F.concat(F.lit(f"{name}-"), version))
    out = F.lit("UNKNOWN")
    for k in "agl":
        version = F.concat(group(k, 1), group(k, 4))
        dotted = F.when(version == "", version).when(version.contains("."), version).otherwise(F.concat(version, F.lit(".0")))
        later = F.when(version == "", F.lit("")).when(F.concat(group(k, 3), group(k, 5)) != "", F.lit("-or-later")).otherwise(F.lit("-only"))
        out = F.when(id_ == k, F.concat(with_version(SENTENCES[k][0], dotted), later)).otherwise(out)
    for k in "poes":
        version = F.concat(*[group(k, n) for n in range(1, 4 if k == "p" else 3)])
        out = F.when(id_ == k, with_version(SENTENCES[k][0], F.when((version == "") | version.contains("."), version).otherwise(F.concat(version, F.lit(".0"))))).otherwise(out)
    for k in "cC":
        kind = group(k, 1)
        for long, short in (("attribution", "by"), ("non-?commercial", "nc"), ("share-?alike", "sa"), ("no-?deriv(?:ative)?s?", "nd"), (" ", "-")):
            kind = F.regexp_replace(kind, long, short)
        out = F.when(id_ == k, F.concat(F.lit("CC-"), F.upper(kind), F.when(group(k, 2) == "", F.lit("")).otherwise(F.concat(F.lit("-"), group(k, 2))))).otherwise(out)
    clauses = F.concat(group("b", 1), group("b", 2))
    out = F.when(id_ == "b", F.when(clauses == "", F.lit("BSD")).otherwise(F.concat(F.lit("BSD-"), clauses, F.lit("-Clause")))).otherwise(out)
    return F.when(id_ == "x", F.concat(F.lit("SPDX:"), group("x", 1))).otherwise(out)


def _sentences(text: Column) -> Column:
    """start, end (code points) and the normalised text of all sentences with a word of GATE."""

    def placed(x: Column) -> Column:
        lengths = F.transform(x["own"], lambda s, i: F.char_length(s) + F.coalesce(F.char_length(F.get(x["ends"], i)), F.lit(0)))
        each = C.bind(prefix_sums(lengths), lambda p: F.transform(x["own"], lambda s, i: F.struct(F.get(p, i).alias("start"), (F.get(p, i) + F.char_length(s)).alias("end"), s.alias("s"))))
        return F.transform(F.filter(each, lambda s: s["s"].rlike(GATE)), lambda s: F.struct(s["start"], s["end"], normal(s["s"]).alias("norm")))

    return C.bind(F.struct(F.split(text, END, -1).alias("own"), F.regexp_extract_all(text, F.lit(END), F.lit(0)).alias("ends")), placed)


def _identified(sentence: Column) -> Column:
    """The known sentences of one sentence, as (id, detail, start, end) with the span of the whole sentence."""

    def one(part: Column) -> Column:
        return C.bind(F.struct(part.alias("p"), _id(part).alias("k")), lambda x: F.struct(x["k"].alias("id"), _detail(x["k"], x["p"]).alias("name"), sentence["start"].alias("start"), sentence["end"].alias("end")))

    known = F.transform(F.regexp_extract_all(sentence["norm"], F.lit(ANY), F.lit(0)), one)
    rest = F.regexp_replace(sentence["norm"], ANY, "|")
    left = F.struct(F.lit("u").alias("id"), F.lit("UNKNOWN").alias("name"), sentence["start"].alias("start"), sentence["end"].alias("end"))
    return F.when(rest.rlike(LEFT), F.concat(known, F.array(left))).otherwise(known)


def _ruled(found: Column) -> Column:
    """license, start, end, ids of the places where rules fit the sequence of ids."""
    kind = "array<struct<license:string,start:int,end:int,ids:string>>"

    def named(m: Column, own: Column) -> Column:
        first, last = F.get(own, m["start"]), F.get(own, m["end"] - 1)
        license_ = F.lit("UNKNOWN")
        for pattern, name in reversed(RULES):
            license_ = F.when(m["part"].rlike(f"^(?:{pattern})$"), F.lit(name) if name else first["name"]).otherwise(license_)
        return F.struct(license_.alias("license"), first["start"].alias("start"), last["end"].alias("end"), m["part"].alias("ids"))

    def ruled(own: Column) -> Column:
        ids = F.array_join(F.transform(own, lambda x: x["id"]), "")
        return F.transform(matches(ids, "|".join(f"(?:{p})" for p, _ in RULES)), lambda m: named(m, own))

    return C.bind(F.filter(found, lambda x: ~x["id"].isin("R", "K")), ruled).cast(kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ids (of all known sentences, in order), licenses (array of license, start, end in code
    points of its first to last sentence, and the ids that its rule took). Null and empty texts have none; rows that repeat an
    id are scanned each; other columns are ignored.
    """
    text = C.text_of(text_col)
    found = F.when(text.rlike(GATE), F.flatten(F.transform(_sentences(text), _identified))).otherwise(F.array()).cast("array<struct<id:string,name:string,start:int,end:int>>")
    both = C.bind(found, lambda f: F.struct(F.array_join(F.transform(f, lambda x: x["id"]), "").alias("ids"), F.when(F.size(f) > 0, _ruled(f)).otherwise(F.array()).alias("licenses")))
    return docs.select(F.col(id_col), both.alias("x")).select(id_col, "x.ids", "x.licenses")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "ids", F.size("licenses").cast("long").alias("n_licenses"), spans.alias("licenses"))
