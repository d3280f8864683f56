"""Linking typed variants of names to the entities meant (problem 4).

Entities and typed names are written in plain forms (lower case, no accents, no titles or legal endings, reordered parts turned round, nicknames
and initials as forms of their own, each with a cost). Every entity form is cut into k+1 segments, k being the typos allowed in it. A typo harms one of
them, so a name within k typos has one unharmed, at most k places aside; only a swap of neighbours, which counts as one typo, harms two where it
crosses a cut. So the two segments beside each cut are in the index with the letters at the cut swapped as well: either one of these is found, or no
swap crosses that cut. The segments are an inverted index that the names' substrings are looked up in; what they find is verified by a banded edit
distance. Of the entities found the cheapest counts, if it is the only one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import saved

# fixed values: short forms of given names
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex sasha sandy", "andrew": "andy drew", "anthony": "tony", "barbara": "barb barbie", "benjamin": "ben benny",
    "catherine": "cathy kate katie", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy",
    "deborah": "deb debbie", "donald": "don donnie", "dorothy": "dot dottie dolly", "edward": "ed eddie ted ned", "eleanor": "ellie nell nora",
    "elizabeth": "liz lizzie beth betty eliza", "florence": "flo florrie", "frederick": "fred freddie", "gabriel": "gabe", "george": "georgie",
    "gregory": "greg", "henry": "hank harry hal", "isabella": "bella izzy isa", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny",
    "jessica": "jess jessie", "john": "jack johnny jon", "jonathan": "jon jonny nathan", "joseph": "joe joey", "josephine": "jo josie",
    "joshua": "josh", "katherine": "kate kathy katie kat", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo",
    "margaret": "meg maggie peggy", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nate nat", "nicholas": "nick nicky",
    "pamela": "pam", "patricia": "pat patty trish", "penelope": "penny", "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becky becca",
    "richard": "rick dick rich richie", "robert": "bob bobby rob robbie bert", "ronald": "ron ronnie", "samantha": "sam", "samuel": "sam sammy",
    "stephen": "steve stevie", "susan": "sue susie", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy",
    "victoria": "vicky tori", "vincent": "vince", "walter": "walt wally", "william": "bill billy will willie liam", "zachary": "zach zack",
}
# fixed values: endings of a legal form, titles, short forms of words in organizations' names, words that stand for no name
LEGAL = {"ag", "co", "company", "cooperative", "coop", "corp", "corporation", "gmbh", "inc", "incorporated", "limited", "llc", "ltd", "plc", "sa"}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "the"}
WORDS = {"assoc": "associates", "assocs": "associates", "bros": "brothers", "grp": "group", "intl": "international", "mfg": "manufacturing", "svc": "services", "svcs": "services", "sys": "systems", "and": ""}
NO_NAMES = frozenset({"", "client", "everyone", "i", "me", "myself", "self", "support", "tbd", "team", "the", "them", "they", "we", "us", "you", "who", "n a", "none", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"})
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i", "ð": "d"})


def plain_tokens(name: str) -> list[str]:
    """Lower-case tokens without accents, possessive endings and punctuation; dotted capitals are joined."""
    s = unicodedata.normalize("NFKD", name.lower().translate(_PLAIN))
    s = "".join(c for c in s if not unicodedata.combining(c)).strip()
    s = re.sub(r"['’´`]s\b", "", s).replace("'", "").replace("’", "")
    s = re.sub(r"\b(g\.m\.b\.h|l\.l\.c|a\.g|l\.t\.d|i\.n\.c|s\.a|p\.l\.c)\.?(?!\w)", lambda m: m[1].replace(".", ""), s)
    return re.findall(r"[^\W_]+", re.sub(r"\bco-op\b", "coop", s).replace("&", " and "))


def entity_forms(kind: str, name: str) -> list[tuple[str, float, str]]:
    """(form, cost, middle initial) of an entity's name or alias."""
    t = [w for w in plain_tokens(name) if w not in TITLES]
    if not t:
        return []
    out: dict[str, float] = {}

    def add(form: str, cost: float) -> None:
        if len(form) > 1:
            out[form] = min(cost, out.get(form, 9))

    mid = ""
    if kind == "person":
        mid = next((w for w in t[1:-1] if len(w) == 1), "")
        t = [t[0], *[w for w in t[1:] if len(w) > 1]]
        if len(t) < 2:
            add(t[0], 2.0)
        else:
            given, sur = t[0], " ".join(t[1:])
            add(f"{given} {sur}", 0)
            shorts = {n: full for full, ns in NICKNAMES.items() for n in ns.split()}
            fulls = [full for full, ns in NICKNAMES.items() if given in ns.split()] if given in shorts else []
            for n in {*NICKNAMES.get(given, "").split(), *fulls}:
                add(f"{n} {sur}", 0.4)
            add(f"{given[0]} {sur}", 0.6)
            add(f"{given} {sur[0]}", 0.8)
            for k in (2, 3, 4):
                if len(given) > k:
                    add(f"{given[:k]} {sur}", 0.5)
            add(f"{given[0]}{sur}", 0.8)
            add(f"{given[0]}{sur.replace(' ', '')}", 0.8)
            add(sur, 1.2)
    else:
        words = [WORDS.get(w, w) for w in t]
        core = [w for w in words if w not in LEGAL and w]
        if not core:
            return []
        add(" ".join(core), 0)
        for n in range(2, len(core)):
            add(" ".join(core[:n]), 0.3)
        if len(core) > 1:
            add(f"{core[0]} {core[-1]}", 0.4)
            for k in (3, 4, 5):
                add(f"{core[0]} {core[1][:k]}", 0.5)
        if len(core) > 2:
            add("".join(w[0] for w in core), 1.0)
        if len([w for w in words if w]) > 2:
            add("".join(w[0] for w in words if w), 1.0)
        add(core[0], 1.2)
    return [(f, c, mid) for f, c in out.items()]


def name_forms(name: str, no_names: frozenset[str] = NO_NAMES) -> list[tuple[str, float, str]]:
    """(form, cost, middle initial) of a typed name; none if it is no name."""
    handle = name.strip().startswith("@")
    t = plain_tokens(name)
    if " ".join(w for w in t if w != "the") in no_names or not t:
        return []
    t = [w for w in t if w not in TITLES] or t
    words = [w for w in (WORDS.get(w, w) for w in t) if w and w not in LEGAL] or t
    mid = next((w for w in words[1:] if len(w) == 1), "")
    first = words[0]
    long = [w for w in words[1:] if len(w) > 1]
    out: dict[str, float] = {}

    def add(ws: list[str], cost: float) -> None:
        form = " ".join(w for w in ws if w)
        if len(form) > 1 and len(form.replace(" ", "")) > 1:
            out[form] = min(cost, out.get(form, 9))

    if handle:
        add(words, 0)
        add(["".join(words)], 0)
        return [(f, c, "") for f, c in out.items()]
    if "," in name.strip().rstrip(",. "):
        head, tail = name.split(",", 1)
        back = [w for w in plain_tokens(tail) if w not in TITLES and w not in LEGAL]
        front = [w for w in plain_tokens(head) if w not in TITLES and w not in LEGAL]
        if back and front:
            mid = next((w for w in back[1:] if len(w) == 1), mid)
            add([back[0], *[w for w in back[1:] if len(w) > 1], *front], 0)
            add([*front, *back], 0.2)
            return [(f, c, mid) for f, c in out.items()]
    add([first, *long], 0)
    if len(words) == 2 and len(words[1]) == 1:
        return [(f"{first} {words[1]}", 0.0, "")]  # given name and initial
    if len(words) > 1:
        add([words[-1], *words[:-1]], 0.3)  # last name first
        add([*words[1:], first], 0.3)
    return [(f, c, mid) for f, c in out.items()]


def typos(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, over a band of 2*most+1 diagonals; most+1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    two, one = {}, {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        row = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                row[0] = i
                continue
            d = min(one.get(j, far) + 1, row.get(j - 1, far) + 1, one.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, two.get(j - 2, far) + 1)
            row[j] = d
        if min(row.values()) > most:
            return far
        two, one = one, row
    return min(one.get(len(b), far), far)


def allowed(length: F.Column) -> F.Column:
    """Typos allowed in a form of this length."""
    return F.when(length < 5, 0).when(length < 9, 1).otherwise(2)


def _forms(df: DataFrame, make, columns: list[str], schema: str) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*r, *f) for r in batch[columns].itertuples(index=False, name=None) for f in make(r)]
            yield pd.DataFrame(rows, columns=[*columns, "form", "cost", "mid"])

    return df.select(*columns).mapInPandas(run, schema)


def segment_index(forms: DataFrame) -> DataFrame:
    """(known_form, len, no, piece) of forms (one column `form`): the k+1 segments of each, and those beside a cut with the letters at the cut swapped."""
    n = F.length("form")
    cut = forms.select(F.col("form").alias("known_form"), n.alias("len"), allowed(n).alias("k"))
    step = F.floor(F.col("len") / (F.col("k") + 1)).cast("int")

    def piece(form: Column, no: Column) -> Column:
        return F.struct(no.alias("no"), F.substring(form, no * step + 1, F.when(no == F.col("k"), F.col("len") - no * step).otherwise(step)).alias("piece"))

    def swapped(no: Column) -> Column:
        at = no * step  # the cut before segment no
        form = F.concat(F.substring("known_form", F.lit(1), at - 1), F.substring("known_form", at + 1, F.lit(1)), F.substring("known_form", at, F.lit(1)), F.substring("known_form", at + 2, F.col("len")))
        return F.array(piece(form, no - 1), piece(form, no))

    whole = F.transform(F.sequence(F.lit(0), "k"), lambda no: piece(F.col("known_form"), no))
    crossed = F.when(F.col("k") > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest("k", F.lit(1))), swapped))).otherwise(F.array().cast("array<struct<no: int, piece: string>>"))
    return cut.select("known_form", "len", F.explode(F.array_distinct(F.concat(whole, crossed))).alias("x")).select("known_form", "len", "x.no", "x.piece")


def segment_probes(forms: DataFrame) -> DataFrame:
    """(form, len, no, piece) of typed forms (one column `form`): the substrings where a known form of `len` letters, within its typos of this length, may
    have its segment `no`, up to k places aside."""
    probe = forms.withColumn("own", F.length("form"))
    probe = probe.select("form", "own", F.explode(F.sequence(F.greatest(F.col("own") - 2, F.lit(2)), F.col("own") + 2)).alias("len"))
    probe = probe.withColumn("k", allowed(F.col("len"))).filter(F.abs(F.col("len") - F.col("own")) <= F.col("k"))
    probe = probe.select("form", "own", "len", "k", F.explode(F.sequence(F.lit(0), "k")).alias("no"))
    probe = probe.select("form", "own", "len", "no", "k", F.explode(F.sequence(-F.col("k"), F.col("k"))).alias("shift"))
    step = F.floor(F.col("len") / (F.col("k") + 1)).cast("int")
    begin, size = F.col("no") * step + F.col("shift"), F.when(F.col("no") == F.col("k"), F.col("len") - F.col("no") * step).otherwise(step)
    probe = probe.select("form", "own", "len", "no", begin.alias("begin"), size.alias("size")).filter("begin >= 0 and begin + size <= own")
    return probe.select("form", "len", "no", F.col("form").substr(F.col("begin") + 1, F.col("size")).alias("piece"))


def close_forms(asked: DataFrame, known: DataFrame, tasks: int) -> DataFrame:
    """(form, known_form, typos) for all forms of asked and known (one column `form` each) that are within the typos allowed. Few bytes but much work, so
    a given number of tasks shares it, which adaptive execution leaves as it is."""
    by = ["len", "no", "piece"]
    met = segment_probes(asked).repartition(tasks, *by).join(segment_index(known), by).select("form", "known_form").distinct().repartition(tasks, "form", "known_form")

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([typos(x, y, 2) for x, y in zip(a, b)])

    near = met.filter(F.levenshtein("form", "known_form", 4) >= 0)  # a swap counts as two here
    return near.withColumn("typos", distance("form", "known_form")).filter(F.col("typos") <= allowed(F.length("known_form")))


def link_names(
    names: DataFrame, name_col: str, entities: DataFrame, id_col: str = "entity_id", entity_name: str = "name", aliases: str = "aliases", kind_col: str = "entity_type", margin: float = 0.3,
    no_names: frozenset[str] = NO_NAMES,
) -> DataFrame:
    """(typed_name, entity_id, cost): for every distinct typed name that means exactly one entity, that entity.

    The cost is the number of typos plus the costs of the forms; a middle initial that contradicts the entity's adds 1. A name of which another
    entity is within `margin` of the cheapest one's cost fits several and gets no row; neither do null or blank names and those in `no_names`
    (pronouns, weekdays and other words that are no names, in lower case). Null aliases count as none; entities without an id or name are left out;
    repeated entity rows count once. Other columns are ignored.
    """
    typed = names.select(F.col(name_col).alias("typed_name")).filter("trim(typed_name) <> ''").distinct()
    named = (
        entities.select(F.col(id_col).alias("entity_id"), F.col(kind_col).alias("kind"), F.explode(F.array_compact(F.array_append(F.coalesce(aliases, F.array().cast("array<string>")), F.col(entity_name)))).alias("called"))
        .filter("entity_id is not null")
        .distinct()
    )
    id_type = named.schema["entity_id"].dataType.simpleString()
    tasks = 2 * names.sparkSession.sparkContext.defaultParallelism
    known = _forms(named.repartition(tasks, "called"), lambda r: entity_forms(r[1], r[2]), ["entity_id", "kind", "called"], f"entity_id {id_type}, kind string, called string, form string, cost double, mid string")
    known = saved(known.groupBy("entity_id", "form", "mid").agg(F.min("cost").alias("cost")), "known-forms")
    asked = saved(_forms(typed.repartition(tasks, "typed_name"), lambda r: name_forms(r[0], no_names), ["typed_name"], "typed_name string, form string, cost double, mid string"), "typed-forms")
    close = close_forms(asked.select("form").distinct(), known.select("form").distinct(), tasks)
    fits = saved(
        asked.withColumnsRenamed({"cost": "c1", "mid": "m1"})
        .join(close, "form")
        .join(known.withColumnsRenamed({"form": "known_form", "cost": "c2", "mid": "m2"}), "known_form")
        .withColumn("cost", F.col("typos") + F.col("c1") + F.col("c2") + F.when((F.col("m1") != "") & (F.col("m2") != "") & (F.col("m1") != F.col("m2")), 1.0).otherwise(0.0))
        .groupBy("typed_name", "entity_id")
        .agg(F.min("cost").alias("cost")),
        "fits",
    )
    # the two cheapest entities of a name decide; nothing else is kept
    best = fits.groupBy("typed_name").agg(F.min(F.struct("cost", "entity_id")).alias("first"))
    rival = fits.join(best, "typed_name").filter((F.col("entity_id") != F.col("first.entity_id")) & (F.col("cost") < F.col("first.cost") + margin)).select("typed_name").distinct()
    return best.join(rival, "typed_name", "left_anti").select("typed_name", F.col("first.entity_id").alias("entity_id"), F.round("first.cost", 3).alias("cost"))
