"""License scans by ordered signature rules.

Some hundreds of regexes (a few phrasings for each license) are written over
lower-cased text.  A text is looked at only when a gate made of the rules' own
parts (a word, then a regex) finds something; of the rules, only those whose own
keyword (one word, so that line breaks do not matter) occurs are run.  Detections are
resolved by priority and containment: one whose interval lies inside that of
another detection of the same or a better priority is suppressed.  DataFrame /
SQL functions only; nothing is shuffled.

Base phrases are found as consecutive words (ASCII letters and digits, A-Z
lower-cased, and everything beyond ASCII) and are never suppressed.

Defined results: null is empty text, without words or labels; repeated rows are
scanned each for itself; a null id gets its own row; other columns are not read.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, matched_spans

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word of the text as given: after lower-casing, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, identifier regex, name regex (lower case).
LICENSES = (
    ("apache-2.0", r"apache-2\.0", r"apache(?: software)? license(?:,? (?:version|v\.?) ?2(?:\.0)?)?"),
    ("apache-1.1", r"apache-1\.1", r"apache(?: software)? license,? (?:version|v\.?) ?1\.1"),
    ("mit", r"mit", r"mit(?:/x11)? licen[sc]e"),
    ("mit-0", r"mit-0", r"mit no attribution(?: license)?"),
    ("x11", r"x11", r"x11 license"),
    ("isc", r"isc", r"isc licen[sc]e"),
    ("bsd-2-clause", r"bsd-2-clause", r"(?:simplified|freebsd|2-clause|two-clause) bsd licen[sc]e|bsd 2-clause(?: licen[sc]e)?"),
    ("bsd-3-clause", r"bsd-3-clause", r"(?:new|revised|modified|3-clause|three-clause) bsd licen[sc]e|bsd 3-clause(?: licen[sc]e)?"),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:original|4-clause|four-clause) bsd licen[sc]e"),
    ("0bsd", r"0bsd", r"zero[- ]clause bsd(?: licen[sc]e)?"),
    ("bsd", r"bsd", r"bsd(?:-style)? licen[sc]e"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public license|gpl),? ?(?:version |v\.? ?)1(?:\.0)?"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public license|gpl),? ?(?:version |v\.? ?)2(?:\.0)?"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public license|gpl),? ?(?:version |v\.? ?)3(?:\.0)?"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:library general public license|lgpl),? ?(?:version |v\.? ?)2(?:\.0)?"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lesser general public license|lgpl),? ?(?:version |v\.? ?)2\.1"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lesser general public license|lgpl),? ?(?:version |v\.? ?)3(?:\.0)?"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:affero general public license|agpl)(?:,? ?(?:version |v\.? ?)3(?:\.0)?)?"),
    ("gfdl-1.3", r"gfdl-1\.[123](?:-only|-or-later)?", r"(?:gnu )?free documentation license(?:,? version 1\.[123])?"),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla public license,? (?:version |v\.? ?)1\.1"),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla public license(?:,? (?:version |v\.? ?)2(?:\.0)?)?"),
    ("epl-1.0", r"epl-1\.0", r"eclipse public license(?:,? ?-? ?(?:version |v\.? ?)1(?:\.0)?)"),
    ("epl-2.0", r"epl-2\.0", r"eclipse public license(?:,? ?-? ?(?:version |v\.? ?)2(?:\.0)?)?"),
    ("cddl-1.0", r"cddl-1\.0", r"common development and distribution license(?:,? ?(?:version |v\.? ?)1(?:\.0)?)?"),
    ("cddl-1.1", r"cddl-1\.1", r"common development and distribution license,? ?(?:version |v\.? ?)1\.1"),
    ("cpl-1.0", r"cpl-1\.0", r"common public license(?:,? ?(?:version |v\.? ?)1(?:\.0)?)?"),
    ("eupl-1.2", r"eupl-1\.2", r"european union public licen[sc]e(?:,? ?(?:version |v\.? ?)1\.2)?"),
    ("bsl-1.0", r"bsl-1\.0", r"boost software license(?:,? ?(?:version |v\.? ?)1(?:\.0)?)?"),
    ("busl-1.1", r"busl-1\.1", r"business source license(?:,? ?(?:version |v\.? ?)?1\.1)?"),
    ("artistic-2.0", r"artistic-2\.0", r"artistic license(?:,? ?(?:version |v\.? ?)?2(?:\.0)?)?"),
    ("zlib", r"zlib", r"zlib(?:/libpng)? licen[sc]e"),
    ("libpng", r"libpng(?:-2\.0)?", r"libpng licen[sc]e"),
    ("unlicense", r"unlicense", r"(?:the )?unlicense"),
    ("wtfpl", r"wtfpl", r"do what the f[u*]ck you want to public license"),
    ("ms-pl", r"ms-pl", r"microsoft public license"),
    ("ms-rl", r"ms-rl", r"microsoft reciprocal license"),
    ("ofl-1.1", r"ofl-1\.1", r"(?:sil )?open font license(?:,? ?(?:version |v\.? ?)?1\.1)?"),
    ("odbl-1.0", r"odbl-1\.0", r"open (?:data commons open )?database license(?:,? ?v?1\.0)?"),
    ("odc-by-1.0", r"odc-by-1\.0", r"open data commons attribution license(?:,? ?v?1\.0)?"),
    ("pddl-1.0", r"pddl-1\.0", r"public domain dedication and license"),
    ("cc0-1.0", r"cc0-1\.0", r"(?:creative commons )?cc0(?: 1\.0)?(?: universal)?"),
    ("cc-by-4.0", r"cc-by-4\.0", r"(?:creative commons attribution|cc by)(?: international)?,? ?4\.0"),
    ("cc-by-3.0", r"cc-by-3\.0", r"(?:creative commons attribution|cc by)(?: unported)?,? ?3\.0"),
    ("cc-by-sa-4.0", r"cc-by-sa-4\.0", r"(?:creative commons attribution-share ?alike|cc by-sa),? ?4\.0"),
    ("cc-by-sa-3.0", r"cc-by-sa-3\.0", r"(?:creative commons attribution-share ?alike|cc by-sa),? ?3\.0"),
    ("cc-by-nc-4.0", r"cc-by-nc-4\.0", r"(?:creative commons attribution-non ?commercial|cc by-nc),? ?4\.0"),
    ("cc-by-nd-4.0", r"cc-by-nd-4\.0", r"(?:creative commons attribution-no ?derivatives|cc by-nd),? ?4\.0"),
    ("cc-by-nc-sa-4.0", r"cc-by-nc-sa-4\.0", r"(?:creative commons attribution-non ?commercial-share ?alike|cc by-nc-sa),? ?4\.0"),
    ("cc-by-nc-nd-4.0", r"cc-by-nc-nd-4\.0", r"(?:creative commons attribution-non ?commercial-no ?derivatives|cc by-nc-nd),? ?4\.0"),
    ("python-2.0", r"(?:python|psf)-2\.0", r"python software foundation license(?:,? version 2)?"),
    ("openssl", r"openssl", r"openssl licen[sc]e"),
    ("postgresql", r"postgresql", r"postgresql licen[sc]e"),
    ("php-3.01", r"php-3\.01", r"php license(?:,? ?(?:version |v\.? ?)?3\.01)?"),
    ("ruby", r"ruby", r"ruby licen[sc]e"),
    ("sspl-1.0", r"sspl-1\.0", r"server side public license(?:,? ?(?:version |v\.? ?)?1)?"),
    ("elastic-2.0", r"elastic-2\.0", r"elastic license(?:,? ?(?:version |v\.? ?)?2(?:\.0)?)?"),
)
#: How a grant begins.
GRANTED = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered)\s+under\s+"
#: kind, priority (1 is best), score, keyword, pattern of one license.
PHRASINGS = (
    ("tag", 1, 1.0, "spdx", r"spdx-license-identifier:\s*(?:{id})(?![\w.+-])"),
    ("field", 1, 0.95, "licen", r"[\"']?licen[sc]e[\"']?\s*[:=]\s*[\"']?(?:{id}|{name})(?![\w+-])"),
    ("grant", 2, 0.9, "under", GRANTED + r"(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:{name}|{id})(?![\w+-])"),
    ("terms", 2, 0.85, "terms", r"terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?(?:{name})(?![\w+-])"),
    ("name", 3, 0.7, None, r"(?<![\w-])(?:{name})(?![\w+-])"),
)
#: Statements that name no license: label, priority, score, keyword, pattern.
STATEMENTS = (
    ("reserved", 2, 0.8, "rights", r"all\s+rights\s+reserved"),
    ("copyright", 3, 0.4, "copyright", r"copyright\s+(?:\(c\)\s*|©\s*)?(?:19|20)\d\d"),
    ("copyright", 3, 0.4, "copyright", r"copyright\s+(?:\(c\)|©)"),
    ("public-domain", 2, 0.7, "domain", r"(?:dedicated|released|placed)\s+(?:to|into|in)\s+the\s+public\s+domain"),
    ("proprietary", 2, 0.7, "proprietary", r"(?:proprietary\s+and\s+confidential|confidential\s+and\s+proprietary)"),
    ("no-warranty", 4, 0.3, "warrant", r"without\s+warrant(?:y|ies)\s+(?:or\s+conditions\s+)?of\s+any\s+kind"),
    ("mit", 2, 0.9, "hereby", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge"),
    ("bsd", 2, 0.9, "redistribution", r"redistributions?\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    ("isc", 2, 0.9, "permission", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software"),
    ("gpl", 2, 0.8, "foundation", r"published\s+by\s+the\s+free\s+software\s+foundation"),
)
#: One look at a text: (word, regex) pairs; without any of the regexes no rule and no
#: base phrase applies, and without its word (lower case) no regex does.  The first
#: six and the base phrase "cc by" hold for every license name and the kinds tag and field.
GATE = (("licen", r"licen[sc]e"), ("cc0", r"cc0"), ("commons", r"commons"), ("bsd", r"bsd"), ("gpl", r"gpl"),
        ("attribution", r"mit\s+no\s+attribution"), ("under", GRANTED), *(x[3:] for x in STATEMENTS),
        *((max(p.split(" "), key=len), p.replace(" ", GAP)) for p, _ in BASE))


def gated(text: Column, low: Column) -> Column:
    """Whether the text, given in lower case too, is to be looked at."""
    return reduce(or_, [F.contains(low, F.lit(w)) & (F.lit(True) if w == x else text.rlike("(?i)" + x)) for w, x in GATE])


def rules() -> list[dict]:
    """The ordered rules; a rule's keyword is plain text of every match."""
    out = []
    for kind, prio, score, keyword, shape in PHRASINGS:
        for label, ident, name in LICENSES:
            out.append({"label": label, "prio": prio, "score": score, "keyword": keyword or _keyword(name),
                        "regex": shape.format(id=ident, name=name.replace(" ", r"\s+"))})
    for label, prio, score, keyword, regex in STATEMENTS:
        out.append({"label": label, "prio": prio, "score": score, "keyword": keyword, "regex": regex})
    return sorted(out, key=lambda r: r["prio"])


#: Words one of which every name holds.
_NAME_WORDS = ("licen", "cc0", "commons", "public", "bsd", "gpl", "attribution")


def _keyword(name: str) -> str:
    """The gate word of a license name, empty (no gate) where phrasings differ."""
    plain = name.replace("[sc]", "").split("|")[0] if "|" not in name else ""
    return next((w for w in _NAME_WORDS if w in plain.split("(?:")[0]), "")


def detections(text: Column) -> Column:
    """array<struct<start, stop, prio, label, score>> of all rules on lower-cased
    text, by start, longest and best first, suppressed ones removed."""
    table = F.from_json(F.lit(json.dumps(rules())),
                        "array<struct<label:string,prio:int,score:double,keyword:string,regex:string>>")
    live = F.filter(table, lambda r: F.contains(text, r["keyword"]) & F.rlike(text, r["regex"]))
    hits = F.flatten(F.transform(live, lambda r: F.transform(matched_spans(text, r["regex"]), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("stop"), r["prio"].alias("prio"), r["label"].alias("label"),
        r["score"].alias("score")))))
    # sweep in order of start, longest first: furthest end seen so far for each priority
    ends = "array<bigint>"
    kept = "array<struct<start:bigint,stop:bigint,prio:int,label:string,score:double>>"
    levels = max(r["prio"] for r in rules())
    zero = F.struct(F.array_repeat(F.lit(-1).cast("bigint"), levels).cast(ends).alias("ends"),
                    F.array().cast(kept).alias("kept"))

    def sweep(acc, d):
        covered = F.array_max(F.slice(acc["ends"], 1, d["prio"])) >= -d["stop"]
        further = F.transform(acc["ends"], lambda e, i: F.when(i + 1 == d["prio"], F.greatest(e, -d["stop"])).otherwise(e))
        one = F.array(F.struct(d["start"].alias("start"), (-d["stop"]).alias("stop"), d["prio"].alias("prio"),
                               d["label"].alias("label"), d["score"].alias("score")))
        return F.struct(F.when(covered, acc["ends"]).otherwise(further).alias("ends"),
                        F.when(covered, acc["kept"]).otherwise(F.concat(acc["kept"], one)).alias("kept"))

    return F.aggregate(F.sort_array(hits), zero, sweep, lambda acc: acc["kept"])


def phrase_starts(words: Column, phrase: str) -> Column:
    """Positions (from 0) where the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def here(i):
        ok = F.lit(True)
        for k, w in enumerate(parts):
            ok = ok & (F.get(words, i + k) == w)
        return ok

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(
        F.array().cast("array<int>"))


PLACES = "array<struct<label:string,at:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (array<struct<label, at>>), found (detections)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # lower() changes more than A-Z, so it serves the gate only
    step = docs.select("doc_id", text.alias("text"), F.lower(text).alias("low"))
    step = step.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"),
                       F.when(gated(F.col("text"), F.col("low")), F.translate("text", UPPER, LOWER)).alias("lowered"))
    words = F.regexp_extract_all("lowered", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    step = step.select("doc_id", "n_words", "lowered", F.when(F.col("lowered").isNotNull(), words).alias("words"))

    def labelled(label):
        return lambda i: F.struct(F.lit(label).alias("label"), i.cast("bigint").alias("at"))

    places = F.concat(*[F.transform(phrase_starts(F.col("words"), p), labelled(name)) for p, name in BASE])
    return step.select("doc_id", "n_words", F.when(F.col("lowered").isNotNull(), places).alias("places"),
                       F.when(F.col("lowered").isNotNull(), detections(F.col("lowered"))).alias("found"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    none = F.array().cast("array<string>")
    base = F.coalesce(F.sort_array(F.array_distinct(F.col("places.label"))), none)
    more = F.coalesce(F.col("found.label"), none)
    return found.select(
        "doc_id", "n_words", F.size(F.coalesce("places", F.array().cast(PLACES))).cast("bigint").alias("n_base"),
        F.array_min(F.col("places.at")).alias("first_word"), F.array_max(F.col("places.at")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.col("found.score")), F.lit(0.0)),
                   F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"))
