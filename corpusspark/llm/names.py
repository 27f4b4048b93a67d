"""Problem 2: the spellings of one person or organisation.

Method: canonical rewritings. Rules for titles, nicknames, initials, legal forms, token order, dropped words and one typing error turn
each distinct name into forms; the forms are exploded and equi-joined. A form is scored by its rarity and by the share of its rows that
its likeliest entity has: one that several entities share (an initial with a common surname) links nothing, one that leads nearly always
to the same one links, the rarest first.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

#: The largest share of a name's rows that one misspelling of it has; few rows may exceed it by chance.
TYPING_SHARE = 0.1
#: The least share of a partial form's rows that the entity it links to has.
FORM_SHARE = 0.9

#: Values that name nobody (fixed values).
PLACEHOLDERS = frozenset("unknown various none null na n/a admin administrator anonymous anon author authors editor staff user guest test tba tbd nobody unnamed untitled multiple several misc other undefined nan".split())
#: Words before or after a name that are no part of it (fixed values).
TITLES = frozenset("by dr prof professor mr mrs ms miss sir dame rev phd md msc bsc mba dphil ed eds editor et al jr sr esq hrsg the of von und and".split())
#: Legal forms and kinds of organisations: abbreviation to word (fixed values).
KINDS = {
    "inst": "institute", "lab": "laboratory", "labs": "laboratory", "dept": "department", "publ": "publishing", "pub": "publishing", "grp": "group", "co": "company", "corp": "corporation",
    "fdn": "foundation", "found": "foundation", "assoc": "association", "assn": "association", "univ": "university", "soc": "society", "ltd": "limited", "inc": "incorporated", "ctr": "center",
}
ORGANISATION = frozenset(KINDS.values()) | frozenset("press gmbh ag llc committee council agency bureau ministry college academy school office".split())
#: Nicknames: formal name to its short forms (fixed values).
_NICKNAMES = """alexander alex sandy; alexandra alex sandra; andrew andy drew; anthony tony; benjamin ben; catherine cathy kate; charles charlie chuck; christopher chris kit; christine chris tina
daniel dan danny; david dave; deborah debbie deb; donald don; dorothy dot dolly; edward ed eddie ted ned; eleanor nell ellie nora; elizabeth liz beth betty lizzie eliza; francis frank; frederick fred freddie
gabriella gabi gabby; gerald gerry jerry; gregory greg; henry harry hank; isabella bella izzy; jacob jake; james jim jimmy; jeffrey jeff; jennifer jen jenny; john jack johnny; jonathan jon jonny
joseph joe joey; josephine josie jo; joshua josh; judith judy; katherine kate kathy katie; kenneth ken; lawrence larry; leonard len leo; margaret peggy maggie meg; matthew matt; maximilian max
michael mike mick; nathaniel nate nat; nicholas nick nicky; pamela pam; patricia pat patty; patrick pat; peter pete; philip phil; raymond ray; rebecca becky; richard dick rick rich; robert bob rob bobby
ronald ron; samantha sam; samuel sam sammy; stephen steve; susan sue susie; theodore ted theo teddy; thomas tom tommy; timothy tim; ulrike uli; victoria vicky tori; vincent vince; walter walt
wilhelm willi; william bill will billy; zacharias zach zack; zachary zach zack""".replace("\n", ";")
NICKNAMES: dict[str, list[str]] = {}
for _line in _NICKNAMES.split(";"):
    _formal, *_short = _line.split()
    for _name in _short:
        NICKNAMES.setdefault(_name, []).append(_formal)


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def rewritings(name: str) -> tuple[list[str], list[str]]:
    """The full and the partial canonical forms of a name; placeholders have none.

    A full form names the entity with all its words, whatever their order. A partial form leaves words out: a person's given name but its
    initial, or a word of an organisation. A name that has nothing but partial forms is short for something else.
    """
    plain = _folded(name).strip()
    if not plain or plain.casefold().strip(" .-") in PLACEHOLDERS:
        return [], []
    outer = re.sub(r"\"[^\"]*\"|“[^”]*”|\([^)]*\)", " ", plain)
    raw = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", outer) or re.findall(r"\w+", plain)
    shouted = not any(c.islower() for c in outer)
    words, initials = [], []
    for token in raw:
        low = token.casefold()
        if low in TITLES:
            continue
        if len(token) == 1:
            initials.append(low)
        elif len(token) <= 3 and token.isupper() and not shouted and low not in KINDS and low not in ORGANISATION:
            initials += list(low)
        else:
            words.append(low)
    if not words or all(w in PLACEHOLDERS for w in words):
        return [], []
    expanded = [KINDS.get(w, w) for w in words]
    kinds = [w for w in expanded if w in ORGANISATION]
    if kinds and len(expanded) > len(kinds):
        rest = [w for w in expanded if w not in ORGANISATION]
        key = "o|" + "|".join(sorted(expanded))
        if len(rest) > 1:
            return [key], ["o|" + "|".join(sorted([*(w for w in rest if w != left), *kinds])) for left in dict.fromkeys(rest)]
        return [], [key]
    if len(words) == 1:
        if not initials:
            return ["s|" + words[0]], []
        return [], ["i|" + words[0] + "|" + initials[0], *(["m|" + words[0] + "|" + "".join(initials[:2])] if len(initials) > 1 else [])]
    full, partial = [], []
    for at, word in enumerate(words):
        rest = words[:at] + words[at + 1 :]
        for formal in [*NICKNAMES.get(word, []), word]:
            full.append("p|" + "|".join(sorted([*rest, formal])))
            for other in rest:
                partial.append(f"i|{other}|{formal[0]}")
                if initials:
                    partial.append(f"m|{other}|{formal[0]}{initials[0]}")
    return list(dict.fromkeys(full)), list(dict.fromkeys(partial))


def typing_forms(key: str) -> list[str]:
    """The key with each of its words set apart, and with one letter of that word taken out; two keys that are one typing error apart share one.

    The words of a key are sorted, so that an error may move its word; initials are no place for an error.
    """
    kind, *words = key.split("|")
    out = set()
    for at, word in enumerate(words[:1] if kind in "im" else words):
        rest = "|".join(words[:at] + words[at + 1 :])
        out.add(f"{kind}|{rest}#{word}")
        out.update(f"{kind}|{rest}#{word[:k]}{word[k + 1 :]}" for k in range(len(word)))
    return sorted(out)


def one_error(a: str, b: str) -> bool:
    """Whether two strings are equal, or one letter inserted, left out, replaced or swapped with its neighbour apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _same_but_one(a: str, b: str) -> bool:
    """Whether two keys of one kind have the same words but for one, which has one error."""
    x, y = a.split("|"), b.split("|")
    if x[0] != y[0] or len(x) != len(y):
        return False
    if x[0] in "im":
        return x[2:] == y[2:] and one_error(x[1], y[1])
    left, right = Counter(x[1:]) - Counter(y[1:]), Counter(y[1:]) - Counter(x[1:])
    return left.total() <= 1 and one_error("".join(left), "".join(right))


def _typing_links(keys: DataFrame) -> DataFrame:
    """``(key, other)``: pairs of keys, both ways, that are one typing error apart; ``keys`` has ``key``."""

    def forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = frame["key"].map(typing_forms)
            yield pd.DataFrame({"key": frame["key"].repeat(lists.map(len)), "form": [f for x in lists for f in x]})

    exploded = keys.select("key").mapInPandas(forms, "key string, form string")
    pairs = exploded.join(exploded.withColumnRenamed("key", "other"), "form").where("key <> other").select("key", "other").distinct()

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_same_but_one(x, y) for x, y in zip(a, b)], dtype=bool)

    return pairs.where(close("key", "other"))


def _followed(moves: DataFrame) -> DataFrame:
    """``(key, root)`` with each chain of moves followed to its end; ``moves`` is ``(key, root)`` without cycles. A round doubles the length that is followed."""
    while True:
        again = moves.select(F.col("key").alias("root"), F.col("root").alias("_then"))
        joined = cut_lineage(moves.join(again, "root", "left").select("key", F.coalesce("_then", "root").alias("root"), F.col("_then").isNotNull().alias("_moved")))
        moves = joined.select("key", "root")
        if not joined.where("_moved").limit(1).count():
            return moves


def _dominant(led: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``led`` whose entity has nearly all ``docs`` of its group."""
    whole = led.groupBy(*by).agg(F.sum("docs").alias("_whole"))
    return led.join(whole, by).where(F.col("docs") >= FORM_SHARE * F.col("_whole")).drop("_whole")


def linked_names(df: DataFrame, name_col: str = "author") -> DataFrame:
    """``(name, entity)`` of each distinct value that names somebody; spellings of one entity share its value.

    Null, blank and placeholder values have no row. Repeated rows count as evidence of a spelling but give one row. A partial name that fits
    several entities, none of which has nearly all rows of the form, stays on its own with the names of the same form. An empty table gives no rows.
    """
    names = df.select(F.col(name_col).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("docs"))

    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = frame["name"].map(rewritings)
            yield pd.DataFrame({"name": frame["name"], "docs": frame["docs"], "full": [b[0] for b in both], "partial": [b[1] for b in both]})

    forms = cut_lineage(names.mapInPandas(rewrite, "name string, docs long, full array<string>, partial array<string>").where("size(full) + size(partial) > 0"))

    # the formal names that a nickname may stand for are keys of their own; a key counts by the spellings of the corpus that support it
    exploded = cut_lineage(forms.where("size(full) > 0").select("name", "docs", F.posexplode("full").alias("at", "key")))
    support = exploded.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("docs").alias("docs"))

    # typing errors: a key with a single spelling, or with no more rows than misspellings of the other explain, moves to its best supported neighbour
    rank = F.struct("spellings", "docs", "key")
    other = support.select(F.col("key").alias("other"), rank.alias("_to"))
    expected = TYPING_SHARE * F.col("_to.docs")
    moves = (
        _typing_links(support).join(support, "key").join(other, "other").where((F.col("_to") > rank) & ((F.col("spellings") == 1) | (F.col("docs") <= expected + 2 * F.sqrt(expected) + 1)))
        .groupBy("key").agg(F.max("_to").alias("to"))
    )
    root = _followed(cut_lineage(moves.select("key", F.col("to.key").alias("root"))))
    root = root.join(support.select(F.col("key").alias("root"), F.col("spellings").alias("gained")), "root")
    strength = F.greatest("spellings", F.coalesce("gained", F.lit(0)))
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(strength), "at", "key"))
    chosen = exploded.select("name", "at", "key").join(support, "key").join(root, "key", "left").withColumn("_best", best).where("_best = 1")
    entities = cut_lineage(chosen.select("name", F.coalesce("root", "key").alias("entity")))

    # partial names: the rarest form that leads to one entity; initials with a middle one are rarer than those without
    led = entities.join(forms.select("name", "docs", F.explode("partial").alias("form")), "name").groupBy("form", "entity").agg(F.sum("docs").alias("docs"))
    led = cut_lineage(led)
    whole = led.agg(F.sum("docs")).first()[0] or 1  # one number
    # a rewriting's score: the share of its rows that the entity has, times its rarity among the rows of all rewritings
    spread = led.groupBy("form").agg(F.sum("docs").alias("_rows"))
    share = F.col("docs") / F.col("_rows")
    weighed = led.join(spread, "form").where(share >= FORM_SHARE).select("form", "entity", (share * F.log(F.lit(float(whole)) / F.col("_rows") + 1)).alias("score"))
    short = cut_lineage(forms.where("size(full) = 0").select("name", F.explode("partial").alias("form")))
    first = F.row_number().over(Window.partitionBy("name").orderBy("error", F.desc("score"), "form"))
    direct = short.join(weighed, "form").select("name", "form", "entity", "score", F.lit(0).alias("error"))
    # a form that full names have is spelled right, even where it fits several of them: such a name isn't tried with typing errors
    spelled = short.join(led.select("form").distinct(), "form", "left_semi")
    left = short.join(spelled.select("name").distinct(), "name", "left_anti")
    near = _typing_links(left.select(F.col("form").alias("key")).unionByName(led.select(F.col("form").alias("key"))).distinct())
    typed = left.join(near.select(F.col("key").alias("form"), F.col("other")), "form").join(led.withColumnRenamed("form", "other"), "other")
    unique = _dominant(typed.groupBy("name", "entity").agg(F.max("docs").alias("docs"), F.min("form").alias("form")), ["name"])
    attached = direct.unionByName(unique.select("name", "form", "entity", F.lit(0.0).alias("score"), F.lit(1).alias("error"))).withColumn("_first", first).where("_first = 1").select("name", "entity")
    alone = short.join(attached.select("name"), "name", "left_anti").groupBy("name").agg(F.min("form").alias("entity"))  # "i|..." sorts first
    return entities.unionByName(attached).unionByName(alone)


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: the pairs of spellings of one entity, the smaller by code points first."""
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
