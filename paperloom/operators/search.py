"""Prefix search over token arrays."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TERMS = 12
RESERVED = "&|!():*'\\"


def terms(query: str | None) -> list[str]:
    """Prefix terms of a query: reserved characters are blanks, the first twelve words count, in lower case."""
    return [t.lower() for t in "".join(" " if c in RESERVED else c for c in query or "").split()[:MAX_TERMS]]


def lexemes(*columns: Column) -> Column:
    """Distinct lower-case words of the columns joined by blanks; null columns are empty."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.array_remove(words, ""))


# The configuration in which each entity's words are read, and the columns that are searched.
CONFIGS = {
    "users": ("simple", ["username"]),
    "sources": ("portuguese", ["name", "description"]),
    "typifications": ("portuguese", ["name"]),
    "taxonomies": ("portuguese", ["title", "description"]),
    "branches": ("portuguese", ["title", "description"]),
    "documents": ("portuguese", ["name", "identifier", "description"]),
}


def tokens_of(columns: Sequence[Column], config: str = "simple") -> Column:
    """Tokens of the columns: words (``simple``) or stems without stop words (``portuguese``)."""
    if config == "simple":
        return lexemes(*columns)
    return portuguese_lexemes(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


def terms_in(query: str | None, config: str = "simple") -> list[str]:
    """terms(), read as the configuration reads words."""
    return terms(query) if config == "simple" else [stem(t) for t in terms(query) if t not in STOP_WORDS]


def _all(tokens: Column, wanted: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.exists(tokens, _begins(t)) for t in wanted], F.lit(True))


def _share(tokens: Column, wanted: list[str]) -> Column:
    hits = [F.size(F.filter(tokens, _begins(t))) for t in wanted]
    return reduce(lambda a, b: a + b, hits, F.lit(0)) / F.greatest(F.size(tokens), F.lit(1))


def _begins(term: str):
    return lambda x: x.startswith(term)


def matches(tokens: Column, query: str | None) -> Column:
    """Every term is a prefix of some token; a blank query matches all."""
    return _all(tokens, terms(query))


def rank(tokens: Column, query: str | None) -> Column:
    """The share of tokens that a term begins: a tie-break among matches."""
    return _share(tokens, terms(query))


def search(df: DataFrame, columns: list[str], query: str | None, config: str = "simple") -> DataFrame:
    """Matching rows with ``rank``; order by the listing's own key first, then rank. A blank query matches all rows, one
    of stop words alone none.

    Tokens come from a generator of one row: no filter is pushed through it, so they are worked out once a row."""
    if not terms(query):
        return df.withColumn("rank", F.lit(0.0))
    wanted = terms_in(query, config)
    own = df.withColumn("__w", F.explode(F.array(tokens_of([F.col(c) for c in columns], config))))
    own = own.where(_all(F.col("__w"), wanted) if wanted else F.lit(False))
    return own.withColumn("rank", _share(F.col("__w"), wanted)).drop("__w")


def search_entity(df: DataFrame, entity: str, query: str | None, config: str | None = None) -> DataFrame:
    """search() in the entity's own columns and configuration; ``config`` takes the latter's place."""
    own, columns = CONFIGS[entity]
    return search(df, columns, query, config or own)


# What a hit counts by the weight of its column.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
# The weight of an entity's columns where it is not D.
WEIGHTED = {"users": "A"}


def positions(columns: dict[str, str], config: str = "simple") -> Column:
    """Words (or stems) of the columns in order, each with what its column's weight counts: its place in the array is its
    position in the row. Stop words keep their place without a term."""

    def of(column: str, weight: str) -> Column:
        text = F.coalesce(F.col(column), F.lit(""))
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "") if config == "simple" else portuguese_words(text)
        return F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(WEIGHTS[weight]).alias("weight")))

    return F.concat(*[of(c, w) for c, w in columns.items()])


def _hits(words: Column, term: str) -> Column:
    """The weights of a prefix term's hits, by position, each over the square of its number among them, summed."""
    start = F.struct(F.lit(0).alias("j"), F.lit(0.0).alias("s"))
    step = lambda acc, w: F.when(w["term"].startswith(term), F.struct((acc["j"] + 1).alias("j"), (acc["s"] + w["weight"] / ((acc["j"] + 1) * (acc["j"] + 1))).alias("s"))).otherwise(acc)  # noqa: E731, E501
    return F.aggregate(words, start, step, lambda acc: acc["s"])


def ranked(df: DataFrame, columns: dict[str, str], query: str | None, config: str = "simple") -> DataFrame:
    """search() over ``columns`` (name -> weight A to D), with ``rank`` by weights and positions.

    A term's hits count their column's weight, the j-th of them by position only a j * j-th part of it, so a first hit weighs
    more than all that repeat it; the rank is the mean over the query's terms of that sum over its limit, pi * pi / 6. It is
    meant to come after the listing's own key. Work in a row follows its words times the query's terms."""
    if not terms(query):
        return df.withColumn("rank", F.lit(0.0))
    wanted = terms_in(query, config)
    own = df.withColumn("__w", F.explode(F.array(positions(columns, config))))
    sums = own.withColumn("__s", F.explode(F.array(F.array(*[_hits(F.col("__w"), t) for t in wanted])))) if wanted else own.where(F.lit(False)).withColumn("__s", F.array(F.lit(0.0)))
    sums = sums.where(F.forall("__s", lambda s: s > 0))
    total = F.aggregate("__s", F.lit(0.0), lambda a, s: a + s)
    return sums.withColumn("rank", total / (max(1, len(wanted)) * math.pi**2 / 6)).drop("__w", "__s")


def ranked_entity(df: DataFrame, entity: str, query: str | None, config: str | None = None) -> DataFrame:
    """ranked() in the entity's own columns, weights and configuration."""
    own, columns = CONFIGS[entity]
    return ranked(df, dict.fromkeys(columns, WEIGHTED.get(entity, "D")), query, config or own)


def postings(df: DataFrame, key: str, columns: list[str], config: str = "simple") -> DataFrame:
    """(term, key): an inverted index; a prefix is a range of terms."""
    return df.select(F.explode(tokens_of([F.col(c) for c in columns], config)).alias("term"), key)


def write_postings(index: DataFrame, key: str, path: str) -> None:
    """Store an index in ranges of (term, key), sorted: search_postings() of what is read back skips files and row groups
    outside its prefixes by their statistics, and a frequent term is shared by several files."""
    index.repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(path)


def search_postings(index: DataFrame, key: str, query: str | None, config: str = "simple") -> DataFrame:
    """Keys for which every term of the query is a prefix of some indexed term."""
    if not terms(query):
        return index.select(key).distinct()
    wanted = terms_in(query, config)
    if not wanted:
        return index.select(key).where(F.lit(False))
    flags = [F.max(F.col("term").startswith(t).cast("int")).alias(f"__{i}") for i, t in enumerate(wanted)]
    near = index.where(reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in wanted]))
    hit = near.groupBy(key).agg(*flags)
    return hit.where(reduce(lambda a, b: a & b, [F.col(f"__{i}") == 1 for i in range(len(wanted))])).select(key)


# -- Portuguese: stop words and suffix stripping after the published Snowball description ----------------------------

# Function words of Portuguese, in no order of weight.
STOP_WORDS = frozenset(
    "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito "
    "nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem "
    "suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês vos lhes meus minhas "
    "teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas isto aquilo "
    "estou está estamos estão foi fomos foram era eram seja sejam ser é são tem têm há".split()
)
VOWELS = "aeiouáéíóúâêô"

# Endings that the published description names, by step. A tilde stands behind its vowel (a~, o~).
PLAIN = (
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador "
    "aça~o adoras adores aço~es ante antes ância"
).split()
REPLACED = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
BEFORE = {  # endings of which another one may go with them
    "mente": ("ante", "avel", "ível"), "idade": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv"),
    "iva": ("at",), "ivo": ("at",), "ivas": ("at",), "ivos": ("at",),
}
BEFORE_AMENTE = ("os", "ic", "ad")
VERBAL = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam "
    "iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas "
    "idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes "
    "estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos "
    "ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos "
    "imos armos ermos irmos eu iu ou ira iras"
).split()
RESIDUAL = ("os", "a", "i", "o", "á", "í", "ó")
_FIRST = sorted([*PLAIN, *REPLACED, *BEFORE, "amente", "ira", "iras"], key=len, reverse=True)
_SECOND = sorted(VERBAL, key=len, reverse=True)


def _regions(word: str) -> tuple[int, int, int]:
    """Where the regions RV, R1 and R2 of the description begin."""
    n, v = len(word), [c in VOWELS for c in word]

    def behind(start: int) -> int:
        return next((i + 1 for i in range(start + 1, n) if not v[i] and v[i - 1]), n)

    r1 = behind(0)
    rv = n
    if n > 2 and not v[1]:
        rv = next((i + 1 for i in range(2, n) if v[i]), n)
    elif n > 2 and v[0]:
        rv = next((i + 1 for i in range(2, n) if not v[i]), n)
    elif n > 2:
        rv = 3
    return rv, r1, behind(r1)


def _cut(word: str, ends: Sequence[str], start: int) -> str:
    """The word without the first of ``ends`` that it has at or after ``start``."""
    return next((word[: -len(e)] for e in ends if word.endswith(e) and len(word) - len(e) >= start), word)


def _standard(word: str, rv: int, r1: int, r2: int) -> str:
    """The first step: the longest ending, if it lies in its region."""
    end = next((e for e in _FIRST if word.endswith(e)), "")
    at = len(word) - len(end)
    if not end:
        return word
    if end in ("ira", "iras"):
        return word[:at] + "ir" if at >= rv and word[:at].endswith("e") else word
    if at < (r1 if end == "amente" else r2):
        return word
    out = word[:at] + REPLACED.get(end, "")
    if end == "amente":
        less = _cut(out, ("iv",), r2)
        return _cut(less, ("at",), r2) if less != out else _cut(out, BEFORE_AMENTE, r2)
    return _cut(out, BEFORE.get(end, ()), r2)


def stem(word: str) -> str:
    """A Portuguese word without its endings."""
    word = word.replace("ã", "a~").replace("õ", "o~")
    rv, r1, r2 = _regions(word)
    out = _standard(word, rv, r1, r2)
    if out == word:
        out = _cut(word, _SECOND, rv)
    if out != word:
        out = out[:-1] if out.endswith("ci") and len(out) > rv else out
    else:
        out = _cut(out, RESIDUAL, rv)
    less = _cut(out, ("e", "é", "ê"), rv)
    if less != out:
        out = less[:-1] if less.endswith(("gu", "ci")) and len(less) > rv else less
    elif out.endswith("ç"):
        out = out[:-1] + "c"
    return out.replace("a~", "ã").replace("o~", "õ")


@F.pandas_udf(T.ArrayType(T.StringType()))
def portuguese_lexemes(text):
    """Distinct stems of the words that are no stop words, in order."""
    held: dict[str, str] = {}

    def one(t):
        words = [w for w in re.findall(r"[^\W_]+", (t or "").lower()) if w not in STOP_WORDS]
        return list(dict.fromkeys(held.setdefault(w, stem(w)) for w in words))

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def portuguese_words(text):
    """Stems of all words in order; a stop word is an empty one."""
    held: dict[str, str] = {}

    def one(t):
        return [held.setdefault(w, "" if w in STOP_WORDS else stem(w)) for w in re.findall(r"[^\W_]+", (t or "").lower())]

    return text.map(one)
