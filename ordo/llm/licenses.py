"""License scan with ordered signature rules.

A text is lower-cased (A-Z) and cut into words; the words joined by single
spaces are what the rules read.  A rule is a regular expression over those
words with a label, a priority and keywords, of which every text that
it matches has one as a word.  The keywords found among a
text's words (one hash look-up per word) decide which rules run at all; texts
without a keyword run none.  Detections are word intervals; one that lies
inside another of higher priority, or inside a longer one of the same
priority, is suppressed.  The labels that remain are reported.

Everything happens inside a document's own row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, match_spans

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but ASCII digits, letters and all non-ASCII characters parts words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that the base counts, and their labels.
BASE: tuple[tuple[str, str], ...] = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Licenses by family: label, keywords (every text of it has one), its name as
#: a regular expression over words, and its versions.
FAMILIES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3")),
    ("gpl", "gnu", r"gnu (?:general public license|gpl)", ("1", "2", "3")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2 1", "3")),
    ("lgpl", "gnu", r"gnu (?:lesser|library) general public license", ("2", "2 1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3")),
    ("agpl", "affero", r"(?:gnu )?affero general public license", ("1", "3")),
    ("gfdl", "gnu", r"gnu free documentation license", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache (?:software )?license", ("1 0", "1 1", "2 0")),
    ("mit", "mit", r"mit", ()),
    ("mit-x11", "x11", r"(?:mit )?x11", ()),
    ("bsd", "bsd", r"bsd", ()),
    ("bsd-2-clause", "bsd freebsd", r"(?:bsd 2 clause|simplified bsd|freebsd)", ()),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd)", ()),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|original bsd)", ()),
    ("isc", "isc", r"isc", ()),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("mpl", "mozilla", r"mozilla public license", ("1 0", "1 1", "2 0")),
    ("epl", "epl", r"epl", ("1 0", "2 0")),
    ("epl", "eclipse", r"eclipse public license", ("1 0", "2 0")),
    ("edl", "eclipse", r"eclipse distribution license", ("1 0",)),
    ("cddl", "cddl", r"cddl", ("1 0", "1 1")),
    ("cddl", "distribution", r"common development and distribution license", ("1 0", "1 1")),
    ("cpl", "common", r"common public license", ("1 0",)),
    ("artistic", "artistic", r"artistic license", ("1 0", "2 0")),
    ("bsl", "boost", r"boost software license", ("1 0",)),
    ("busl", "busl", r"busl", ("1 1",)),
    ("busl", "business", r"business source license", ("1 1",)),
    ("sspl", "sspl", r"sspl", ("1",)),
    ("elastic", "elastic", r"elastic license", ("1 0", "2 0")),
    ("zlib", "zlib", r"zlib(?: libpng)?", ()),
    ("unlicense", "unlicense", r"unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("1", "2")),
    ("cc0", "cc0", r"cc0", ("1 0",)),
    ("cc-by", "cc", r"cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", r"cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", r"cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", r"cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", r"cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc", r"cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative", r"creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s", ("2 0", "3 0", "4 0")),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial", ("2 0", "3 0", "4 0")),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike", ("2 0", "3 0", "4 0")),
    ("odbl", "odbl", r"odbl", ("1 0",)),
    ("odbl", "database", r"open (?:data commons open )?database license", ("1 0",)),
    ("pddl", "domain", r"public domain dedication and license", ("1 0",)),
    ("ofl", "sil", r"sil open font license", ("1 0", "1 1")),
    ("psf", "python", r"python software foundation license", ("2",)),
    ("php", "php", r"php license", ("3 0", "3 01")),
    ("ruby", "ruby", r"ruby license", ()),
    ("ms-pl", "microsoft", r"microsoft public license", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", ()),
    ("upl", "universal", r"universal permissive license", ("1 0",)),
    ("eupl", "eupl", r"eupl", ("1 0", "1 1", "1 2")),
    ("eupl", "european", r"european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("osl", "open", r"open software license", ("1 0", "2 1", "3 0")),
    ("afl", "academic", r"academic free license", ("2 1", "3 0")),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source", ()),
    ("postgresql", "postgresql", r"postgresql license", ()),
    ("openssl", "openssl", r"openssl license", ()),
    ("vim", "vim", r"vim license", ()),
    ("mulan", "mulan", r"mulan (?:psl|permissive software license)", ("1", "2")),
    ("blueoak", "oak", r"blue oak model license", ("1 0 0",)),
    ("openrail", "openrail rail", r"(?:creativeml )?open ?rail(?: m)?", ()),
)

#: Families whose name and version are also written as one word, as in "gplv2".
JOINED = frozenset(("gpl", "lgpl", "agpl"))

#: Notices that are hand-written sentences of a license text: label, keyword, pattern.
NOTICES: tuple[tuple[str, str, str], ...] = (
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "affero", r"under the terms of the gnu affero general public license"),
    ("mpl", "mozilla", r"subject to the terms of the mozilla public license"),
    ("zlib", "warranty", r"provided as is without any express or implied warranty in no event"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:released|dedicated|placed) (?:to|into|in) the public domain"),
    ("wtfpl", "fuck", r"do what the fuck you want to public license"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("cc0", "waived", r"waived all copyright and related or neighboring rights"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?! (?:sa|nd|nc))(?: \d \d)?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: \d \d)?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?! (?:sa|nd))(?: \d \d)?"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: \d \d)?"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: \d \d)?"),
    ("apache", "apache", r"www apache org licenses license 2 0"),
    ("gpl", "gnu", r"www gnu org licenses gpl(?: \d \d)?"),
)


def rules() -> list[tuple[str, str, int, str]]:
    """The ordered rules: label, keywords, priority (higher wins), pattern.

    Each family gives a tag rule, a grant rule, a name rule, and a rule per
    version; notices come first.
    """
    out = [(label, keyword, 5, pattern) for label, keyword, pattern in NOTICES]
    tag = "spdx license identifier"
    grant = r"(?:released|licensed|distributed|available|published|covered)(?: \S+)? (?:under|by) (?:the )?(?:terms of the )?"
    for label, keyword, name, versions in FAMILIES:
        plain = r" licen[cs]e" if "licen" not in name and name not in ("cc by", "cc0") else ""
        loose = f"{name}(?: licen[cs]e)?"
        out.append((label, keyword, 4, f"{tag} {loose}(?: \\d)*(?: only| or later)?"))
        out += [(f"{label}-{v.replace(' ', '.')}", keyword, 3, f"{loose}(?: version)? v?{v}(?! \\d)") for v in versions]
        out.append((label, keyword, 2, f"{grant}{loose}"))
        out.append((label, keyword, 1, name + plain))
        if keyword in JOINED:
            digits = "".join(sorted({v[0] for v in versions}))
            words = " ".join(f"{keyword}{v}{d}" for d in digits for v in ("", "v"))
            one = f"{name}v?[{digits}](?: \\d)*(?: licen[cs]e)?"
            out.append((label, words, 4, f"{tag} {one}(?: only| or later)?"))
            out += [(f"{label}-{v.replace(' ', '.')}", words, 3, f"{name}v?{v}{'' if ' ' in v else '(?: 0)?'}(?! \\d)(?: licen[cs]e)?") for v in versions]
            out.append((label, words, 2, f"{grant}{one}"))
    return out


def rule_table(rows: list[tuple[str, str, int, str]]) -> Column:
    """The rules by keyword, as one constant map."""
    by: dict[str, list[Column]] = {}
    for label, keyword, priority, pattern in rows:  # a rule that two words open finds the same intervals twice
        rule = F.struct(
            F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(f"(?<![^ ])(?:{pattern})(?![^ ])").alias("pattern")
        )
        for word in keyword.split(" "):
            by.setdefault(word, []).append(rule)
    return F.create_map(*[x for k, v in by.items() for x in (F.lit(k), F.array(*v))])


def words_of(text: Column) -> Column:
    """Words after lower-casing; ``lower`` makes no ASCII separator and parts no word."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), lambda w: w != "")


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word numbers where the phrase's words stand one after the other."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return same

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    gate = F.lit(True)
    for part in parts:
        gate = gate & F.array_contains(words, part)
    return F.when(gate, found).otherwise(F.array().cast("array<int>"))


def detections(joined: Column, keywords: Column, table: Column) -> Column:
    """Intervals (from, to, priority, label) of the rules that the keywords open."""

    def spans(rule: Column) -> Column:
        return F.transform(
            match_spans(joined, rule["pattern"]),
            lambda s: F.struct(s["a"].alias("a"), s["z"].alias("z"), rule["priority"].alias("p"), rule["label"].alias("label")),
        )

    opened = F.flatten(F.transform(keywords, lambda k: table[k]))
    return F.flatten(F.transform(opened, spans))


def unsuppressed(found: Column) -> Column:
    """Without intervals inside one of higher priority, or inside a longer one of the same."""

    def beaten(x: Column, all_: Column) -> Column:
        return F.exists(
            all_,
            lambda y: (y["a"] <= x["a"])
            & (y["z"] >= x["z"])
            & ((y["p"] > x["p"]) | ((y["p"] == x["p"]) & (y["z"] - y["a"] > x["z"] - x["a"]))),
        )

    return let(F.array_distinct(found), lambda d: F.filter(d, lambda x: ~beaten(x, d)))


def scan_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[tuple[str, str], ...] = BASE
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the priority of the best remaining detection over 5 (0.2 for
    a bare base phrase, 0 without any).  Null or empty text: no words, empty
    labels, null places, score 0.  Repeated rows and null ids stay; other
    columns are ignored; an empty table gives no rows.
    """
    table_rows = rules()
    keys = F.array(*[F.lit(k) for k in sorted({word for r in table_rows for word in r[1].split(" ")})])
    table = rule_table(table_rows)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def scanned(words: Column) -> Column:
        starts = [(label, phrase_starts(words, phrase)) for phrase, label in base]
        hits = let(
            F.array_intersect(words, keys),
            lambda k: F.when(
                F.size(k) > 0, let(F.array_join(words, " "), lambda joined: unsuppressed(detections(joined, k, table)))
            ),
        )
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.struct(*[s.alias(f"s{i}") for i, (_, s) in enumerate(starts)]).alias("starts"),
            F.transform(hits, lambda x: F.struct(x["label"].alias("label"), x["p"].alias("p"))).alias("hits"),
        )

    rows = source.select("doc_id", let(words_of(F.col("_text")), scanned).alias("r"))
    places = F.flatten(F.array(*[F.col(f"r.starts.s{i}") for i in range(len(base))]))
    said = F.array_distinct(
        F.filter(
            F.array(*[F.when(F.size(F.col(f"r.starts.s{i}")) > 0, F.lit(label)) for i, (_, label) in enumerate(base)]),
            lambda x: x.isNotNull(),
        )
    )
    more = F.coalesce(F.transform("r.hits", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("r.hits", lambda x: x["p"])), F.lit(0)) / F.lit(5.0)
    return rows.select("doc_id", F.col("r.n_words").alias("n_words"), places.alias("at"), said.alias("said"), more.alias("more"), best.alias("best")).select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("said"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("said", "more")), ",").alias("labels"),
        F.greatest(F.col("best"), F.when(F.size("at") > 0, F.lit(0.2)).otherwise(F.lit(0.0))).alias("score"),
    )
