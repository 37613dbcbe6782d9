"""License detection by ordered signature rules, in DataFrame functions alone.

A text is lower-cased (A-Z) and its words are set apart by single blanks. Rules are regular expressions
over these words; each is tried only where one of its keywords is among the words. A detection that lies within
a longer one, or has the same words as one of higher rank, is suppressed: in the order of their starts, longer
ones first, a detection stays if it ends beyond all before it. Null text is empty: no words, no labels, score 0.
Repeated rows are kept each; doc_id may be null or tie (a text is told by doc_id and its hash).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower

#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased, told on the text as it is.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("mit", "license", "mit license"), ("apache", "license", "apache license"), ("gpl", "license", "general public license")]

_V = r"(?: (?:version|v))?"
#: label; keywords, one of which is in whatever the rule matches; what names the license; what identifies it for SPDX, in words. Own signatures, written by hand.
NAMES = f"""
mit; mit expat; (?:the )?mit (?:license|licence|licensed)|licensed under mit|expat license; mit
mit-0; mit; mit no attribution; mit 0
x11; x11; x11 (?:license|licence); x11
apache-1.0; apache; apache (?:software )?license{_V} 1 0; apache 1 0
apache-1.1; apache; apache (?:software )?license{_V} 1 1; apache 1 1
apache-2.0; apache; apache (?:software )?licen[sc]e{_V} 2(?: 0)?|apache 2 0 licensed?; apache 2 0
gpl-1.0; gnu; gnu (?:general public license|gpl){_V} 1(?: 0)?; gpl 1 0(?: only| or later)?
gpl-2.0; gnu; gnu (?:general public license|gpl){_V} 2(?: 0)?; gpl 2 0 only
gpl-2.0-or-later; gnu; gnu (?:general public license|gpl){_V} 2(?: 0)? or (?:at your option )?(?:any )?later; gpl 2 0 or later
gpl-3.0; gnu; gnu (?:general public license|gpl){_V} 3(?: 0)?; gpl 3 0 only
gpl-3.0-or-later; gnu; gnu (?:general public license|gpl){_V} 3(?: 0)? or (?:at your option )?(?:any )?later; gpl 3 0 or later
lgpl-2.0; library; gnu library general public license{_V} 2(?: 0)?; lgpl 2 0(?: only| or later)?
lgpl-2.1; lesser; gnu lesser general public license{_V} 2 1; lgpl 2 1(?: only| or later)?
lgpl-3.0; lesser; gnu lesser general public license{_V} 3(?: 0)?; lgpl 3 0(?: only| or later)?
agpl-1.0; affero; affero general public license{_V} 1(?: 0)?; agpl 1 0(?: only| or later)?
agpl-3.0; affero; (?:gnu )?affero general public license{_V} 3(?: 0)?; agpl 3 0(?: only| or later)?
gfdl-1.1; documentation; gnu free documentation license{_V} 1 1; gfdl 1 1(?: only| or later)?
gfdl-1.2; documentation; gnu free documentation license{_V} 1 2; gfdl 1 2(?: only| or later)?
gfdl-1.3; documentation; gnu free documentation license{_V} 1 3; gfdl 1 3(?: only| or later)?
bsd-2-clause; bsd freebsd; (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license; bsd 2 clause
bsd-3-clause; bsd; (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license; bsd 3 clause
bsd-4-clause; bsd; (?:bsd 4 clause|4 clause bsd|original bsd|old bsd) license; bsd 4 clause
bsd-1-clause; bsd; (?:bsd 1 clause|1 clause bsd) license; bsd 1 clause
0bsd; bsd license; (?:zero clause bsd|bsd zero clause|0 clause bsd|free public) license; 0bsd
bsd; bsd berkeley; bsd(?: style)? license|under the bsd|berkeley software distribution license; bsd
isc; isc consortium; isc license|internet systems consortium license; isc
mpl-1.0; mozilla; mozilla public license{_V} 1 0; mpl 1 0
mpl-1.1; mozilla; mozilla public license{_V} 1 1; mpl 1 1
mpl-2.0; mozilla; mozilla public license{_V} 2(?: 0)?; mpl 2 0
npl-1.1; netscape; netscape public license{_V} 1 [01]; npl 1 1
epl-1.0; eclipse; eclipse public license{_V} 1(?: 0)?; epl 1 0
epl-2.0; eclipse; eclipse public license{_V} 2(?: 0)?; epl 2 0
edl-1.0; eclipse; eclipse distribution license{_V} 1(?: 0)?; edl 1 0
cpl-1.0; common; common public license{_V} 1(?: 0)?; cpl 1 0
ipl-1.0; ibm; ibm public license{_V} 1(?: 0)?; ipl 1 0
cddl-1.0; cddl; common development and distribution license cddl{_V} 1 0|cddl{_V} 1 0; cddl 1 0
cddl-1.1; cddl; common development and distribution license cddl{_V} 1 1|cddl{_V} 1 1; cddl 1 1
cpal-1.0; attribution; common public attribution license{_V} 1(?: 0)?; cpal 1 0
osl-1.0; open; open software license{_V} 1(?: 0)?; osl 1 0
osl-2.0; open; open software license{_V} 2(?: 0)?; osl 2 0
osl-2.1; open; open software license{_V} 2 1; osl 2 1
osl-3.0; open; open software license{_V} 3(?: 0)?; osl 3 0
afl-1.1; academic; academic free license{_V} 1 1; afl 1 1
afl-2.0; academic; academic free license{_V} 2 0; afl 2 0
afl-2.1; academic; academic free license{_V} 2 1; afl 2 1
afl-3.0; academic; academic free license{_V} 3(?: 0)?; afl 3 0
artistic-1.0; artistic; artistic license{_V} 1(?: 0)?; artistic 1 0
artistic-2.0; artistic; artistic license{_V} 2(?: 0)?; artistic 2 0
artistic; artistic; (?:perl )?artistic license; artistic 1 0 perl
bsl-1.0; boost; boost software license(?:{_V} 1(?: 0)?)?; bsl 1 0
busl-1.1; business; business source license(?:{_V} 1 1)?; busl 1 1
sspl-1.0; server; server side public license(?:{_V} 1)?; sspl 1 0
elastic-2.0; elastic; elastic license{_V} 2(?: 0)?; elastic 2 0
eupl-1.0; european; european union public licen[sc]e{_V} 1 0; eupl 1 0
eupl-1.1; european; european union public licen[sc]e{_V} 1 1; eupl 1 1
eupl-1.2; european; european union public licen[sc]e{_V} 1 2; eupl 1 2
cecill-1.0; cecill; cecill{_V} 1 0; cecill 1 0
cecill-2.0; cecill; cecill{_V} 2 0; cecill 2 0
cecill-2.1; cecill; cecill{_V} 2 1; cecill 2 1
cecill-b; cecill; cecill b(?: free software license)?; cecill b
cecill-c; cecill; cecill c(?: free software license)?; cecill c
unlicense; unlicense; the unlicense|unlicense org; unlicense
wtfpl; wtfpl fuck; wtfpl|do what the fuck you want to public license; wtfpl
zlib; zlib; zlib(?: libpng)? license; zlib
libpng; libpng; libpng license(?: version 2)?; libpng(?: 2 0)?
ijg; jpeg; independent jpeg group; ijg
ftl; freetype; freetype (?:project )?license; ftl
imagemagick; imagemagick; imagemagick license; imagemagick
openssl; openssl; openssl (?:and ssleay )?license; openssl
ssleay; ssleay; (?:original )?ssleay license; ssleay standalone
php-3.0; php; php license{_V} 3 0; php 3 0
php-3.01; php; php license{_V} 3 01; php 3 01
python-2.0; python psf; python (?:software foundation )?license(?:{_V} 2)?|psf license; (?:python|psf) 2 0
ruby; ruby; ruby(?: s)? license; ruby
tcl; tcl; tcl tk license|tcl license; tcl
vim; vim; vim license; vim
w3c; w3c; w3c (?:software )?(?:notice and )?license; w3c
curl; curl; curl license; curl
icu; icu; icu license; icu
unicode; unicode; unicode (?:inc )?license(?: agreement)?; unicode (?:dfs 2015|dfs 2016|3 0)
ncsa; ncsa; (?:university of illinois )?ncsa (?:open source )?license; ncsa
ms-pl; microsoft ms; microsoft public license|ms pl; ms pl
ms-rl; microsoft ms; microsoft reciprocal license|ms rl; ms rl
apsl-1.0; apple; apple public source license{_V} 1 0; apsl 1 0
apsl-2.0; apple; apple public source license{_V} 2 0; apsl 2 0
spl-1.0; sun; sun public license{_V} 1 0; spl 1 0
sissl; sun; sun industry standards source license; sissl
nosa; nasa; nasa open source agreement; nasa 1 3
rpl-1.5; reciprocal; reciprocal public license(?:{_V} 1 5)?; rpl 1 5
qpl-1.0; q; q public license(?:{_V} 1 0)?; qpl 1 0
ofl-1.0; sil; sil open font license{_V} 1 0; ofl 1 0
ofl-1.1; sil; sil open font license(?:{_V} 1 1)?; ofl 1 1
lppl-1.0; latex; latex project public license{_V} 1 0; lppl 1 0
lppl-1.3c; latex; latex project public license(?:{_V} 1 3c?)?; lppl 1 3c
odbl-1.0; database; open (?:data commons open )?database license(?:{_V} 1 0)?; odbl 1 0
odc-by-1.0; attribution; open data commons attribution license; odc by 1 0
pddl-1.0; dedication; public domain dedication and license; pddl 1 0
cdla-permissive-1.0; community; community data license agreement permissive(?:{_V} 1 0)?; cdla permissive 1 0
cdla-permissive-2.0; community; community data license agreement permissive{_V} 2 0; cdla permissive 2 0
cdla-sharing-1.0; community; community data license agreement sharing(?:{_V} 1 0)?; cdla sharing 1 0
cc0-1.0; cc0 zero; cc0(?: 1 0)?(?: universal)?|creative commons zero; cc0 1 0
cc-by-1.0; cc commons; (?:cc|commons) (?:by|attribution) 1 0; cc by 1 0
cc-by-2.0; cc; cc by 2 0; cc by 2 0
cc-by-2.5; cc; cc by 2 5; cc by 2 5
cc-by-3.0; cc; cc by 3 0; cc by 3 0
cc-by-4.0; cc; cc by 4 0; cc by 4 0
cc-by-sa-2.0; cc; cc by sa 2 0; cc by sa 2 0
cc-by-sa-3.0; cc; cc by sa 3 0; cc by sa 3 0
cc-by-sa-4.0; cc; cc by sa 4 0; cc by sa 4 0
cc-by-nd-3.0; cc; cc by nd 3 0; cc by nd 3 0
cc-by-nd-4.0; cc; cc by nd 4 0; cc by nd 4 0
cc-by-nc-3.0; cc; cc by nc 3 0; cc by nc 3 0
cc-by-nc-4.0; cc; cc by nc 4 0; cc by nc 4 0
cc-by-nc-sa-3.0; cc; cc by nc sa 3 0; cc by nc sa 3 0
cc-by-nc-sa-4.0; cc; cc by nc sa 4 0; cc by nc sa 4 0
cc-by-nc-nd-3.0; cc; cc by nc nd 3 0; cc by nc nd 3 0
cc-by-nc-nd-4.0; cc; cc by nc nd 4 0; cc by nc nd 4 0
cc-by; commons; creative commons attribution(?: license)?; cc by
cc-by-sa; commons; creative commons attribution share ?alike; cc by sa
cc-by-nd; commons; creative commons attribution no ?deriv(?:ative)?s?; cc by nd
cc-by-nc; commons; creative commons attribution non ?commercial; cc by nc
cc-by-nc-sa; commons; creative commons attribution non ?commercial share ?alike; cc by nc sa
cc-by-nc-nd; commons; creative commons attribution non ?commercial no ?deriv(?:ative)?s?; cc by nc nd
mulanpsl-2.0; mulan; mulan (?:permissive software license|psl)(?: ?v? ?2)?; mulanpsl 2 0
upl-1.0; universal; universal permissive license(?:{_V} 1 0)?; upl 1 0
blueoak-1.0.0; blue; blue oak model license(?: 1 0 0)?; blueoak 1 0 0
postgresql; postgresql; postgresql licen[sc]e; postgresql
hpnd; historical; historical permission notice and disclaimer; hpnd
vsl-1.0; vovida; vovida software license(?:{_V} 1 0)?; vsl 1 0
zpl-2.0; zope; zope public license{_V} 2 0; zpl 2 0
zpl-2.1; zope; zope public license{_V} 2 1; zpl 2 1
llama2; llama; llama 2 community license(?: agreement)?; llama2
llama3; llama; llama 3 community license(?: agreement)?; llama3
openrail-m; openrail rail; (?:creativeml )?open ?rail m(?: license)?; openrail
bigscience-rail; bigscience; bigscience (?:open )?rail license; bigscience rail 1 0
polyform-nc; polyform; polyform noncommercial license(?: 1 0 0)?; polyform noncommercial 1 0 0
commons-clause; clause; commons clause(?: license condition)?; commons clause
"""
#: label; keywords as above, but the disclaimer that other licenses share asks for MIT's word beside it; signature of a grant or notice.
NOTICES = """
mit; permission; permission is hereby granted free of charge to any person obtaining a copy
mit; noninfringement; the software is provided as is without warranty of any kind
isc; permission; permission to use copy modify and or distribute this software for any purpose
bsd; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause; endorse; may be used to endorse or promote products derived from this software
apache-2.0; apache; (?:you may obtain a copy of the license at )?(?:http|https) www apache org licenses license 2 0
gpl; gnu; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl; lesser; under the terms of the gnu lesser general public license
agpl; affero; under the terms of the gnu affero general public license
mpl-2.0; mozilla; this source code form is subject to the terms of the mozilla public license
unlicense; unencumbered; this is free and unencumbered software released into the public domain
cc; creativecommons; (?:http|https)(?: www)? creativecommons org licenses
public-domain; domain; (?:released|placed|dedicated) (?:in|into|to) the public domain
proprietary; rights; all rights reserved
proprietary; proprietary; proprietary and confidential
gpl-2.0; gplv2; gplv2
gpl-3.0; gplv3; gplv3
lgpl-3.0; lgplv3; lgplv3
agpl-3.0; agplv3; agplv3
gpl; gpl; gnu gpl|licensed under the gpl
copyright; copyright; copyright (?:c )?(?:19|20)[0-9][0-9]
"""


def rules() -> list[tuple[str, str, int, float, str]]:
    """(label, keywords, rank, confidence, pattern), in order: tags, notices, names, then the base phrases."""
    split = lambda table: [[x.strip() for x in line.split(";")] for line in table.strip().split("\n")]
    out = [(label, "spdx", 0.99, rf"spdx license identifiers? (?:{tag})") for label, _, _, tag in split(NAMES)]
    out += [(label, key, 0.9, pattern) for label, key, pattern in split(NOTICES)]
    out += [(label, key, 0.8, pattern) for label, key, pattern, _ in split(NAMES)]
    out += [(label, key, 0.6, pattern) for label, key, pattern in BASE]
    return [(label, key, rank, sure, f" (?:{pattern})(?= )") for rank, (label, key, sure, pattern) in enumerate(out)]


def _prefixes(words: set[str]) -> str:
    """A regular expression of these words that shares their beginnings."""
    rests = {c: {w[1:] for w in words if w[:1] == c} for c in sorted({w[:1] for w in words} - {""})}
    some = "|".join(c + _prefixes(rest) for c, rest in rests.items())
    return "" if not some else f"(?:{some})?" if "" in words else f"(?:{some})"


def gate() -> str:
    """What a text has, as it is, if and only if a keyword is among its words."""
    return rf"(?i)(?<!{RAW_WORD[:-1]}){_prefixes({k for r in rules() for k in r[1].split()})}(?!{RAW_WORD[:-1]})"


def _blanks(x):
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), label, base, first, length, rank, sure, kept: a row for each place where a rule matches a text."""
    table = docs.sparkSession.createDataFrame(
        [(label, key, rank, sure, pattern, (label, keys, pattern[4:-6]) in BASE) for label, keys, rank, sure, pattern in rules() for key in keys.split()],
        "label string, keyword string, rank int, sure double, pattern string, base boolean",
    )
    text = F.coalesce("text", F.lit(""))
    gated = docs.filter(text.rlike(gate())).select("doc_id", F.xxhash64(text).alias("t"), ascii_lower("text").alias("low"))
    normal = gated.select("doc_id", "t", F.concat(F.lit(" "), F.trim(F.regexp_replace("low", NOT_WORD, " ")), F.lit(" ")).alias("norm"))
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in rules() for k in r[1].split()})])
    tried = normal.withColumn("keyword", F.explode(F.array_intersect(F.split("norm", " "), keywords))).join(F.broadcast(table), "keyword")
    tried = tried.filter(F.expr("norm rlike pattern"))
    # words before each place and words in it; the last has none in it
    gaps, lengths = F.transform(F.expr("split(norm, pattern, -1)"), _blanks), F.transform(F.expr("regexp_extract_all(norm, pattern, 0)"), _blanks)
    rule = tried.select("doc_id", "t", "rank", "label", "base", "sure", F.arrays_zip(gaps.alias("gap"), lengths.alias("length")).alias("z"))
    rule = rule.repartition("doc_id", "t").dropDuplicates(["doc_id", "t", "rank"])  # several keywords or equal rows
    own = Window.partitionBy("doc_id", "t", "rank").orderBy("place")
    before = F.sum("gap").over(own) + F.coalesce(F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = rule.select("doc_id", "t", "rank", "label", "base", "sure", F.posexplode("z").alias("place", "z")).select("*", "z.gap", "z.length")
    place = place.withColumn("first", before.cast("long")).filter("length is not null").withColumn("length", F.col("length").cast("long")).drop("z", "gap", "place")
    end = F.col("first") + F.col("length")
    wider = Window.partitionBy("doc_id", "t").orderBy("first", F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return place.withColumn("kept", end > F.coalesce(F.max(end).over(wider), F.lit(-1)))


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the kept spans."""
    base, kept = F.col("base"), F.col("kept")
    names = lambda ok: F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("label")))), ",")
    found = detections(docs).groupBy("doc_id", "t").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        names(base).alias("base_labels"), names(base | kept).alias("labels"), F.max(F.when(kept, F.col("sure"))).alias("score"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("first", "length", "label")))).alias("spans"),
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_t"), F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"))
    rows = rows.join(found, rows._id.eqNullSafe(found.doc_id) & (rows._t == found.t), "left")
    return rows.select(
        F.col("_id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array()).alias("spans"),
    )
