"""URL filter: rules first, else naive Bayes over words that a unigram Viterbi finds in host and path."""

from __future__ import annotations

import functools
import math
import re
from collections import ChainMap
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm.common import ASCII_LOWER, ASCII_UPPER, checkpoint, table
from ordinate.llm.urlwords import ALLOWED, BLOCKED, PARTNERS, RANKED

#: (rule, verdict); a rule is a host with a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

PIECE = re.compile(r"[a-z]+")
#: What is no evidence about a site: technical labels and public suffixes.
PLAIN = frozenset("www m com net org co uk edu gov info html htm php asp aspx example http https en de fr es it pt nl pl ru ja zh".split())
#: The most frequent built-in word counts so often; the r-th counts an r-th of it.  A listed word of a kind of site counts as often as the word in the middle.
TOP_COUNT = 2_000_000
#: Log probability by which an unknown stretch begins, and what each of its letters costs.
UNKNOWN, LETTER = -12.0, -2.3
#: A corpus word of the segmenter is one seen in so many distinct hosts and paths (a name seen less is no word, else no name would be segmented).
LEAST_SEEN = 50
#: Up to so many corpus words go to all tasks; more are joined to the names that hold them.
LEXICON = 200_000


@functools.cache
def built_in() -> dict[str, float]:
    """Word -> count, of the built-in lists."""
    count: dict[str, float] = {}
    for rank, word in enumerate(dict.fromkeys(RANKED), 1):
        count[word] = TOP_COUNT / (rank + 10)
    middle = TOP_COUNT / (len(count) / 2)
    for words in (*BLOCKED.values(), *ALLOWED.values(), " ".join(PARTNERS)):
        for word in words.split():
            count.setdefault(word, middle)
    return count


def counted(corpus: dict[str, int] | None = None) -> dict[str, float]:
    """Word -> count, of the built-in lists and what the corpus adds."""
    count = dict(built_in())
    for word, n in (corpus or {}).items():
        count[word] = count.get(word, 0) + n
    return count


def examples() -> list[tuple[str, str]]:
    """Labelled training URLs: each listed word alone and with partners before and after it, and in the path with words of its kind."""
    out = []
    for label, kinds in (("block", BLOCKED), ("allow", ALLOWED)):
        for kind, words in kinds.items():
            listed = words.split()
            for k, word in enumerate(listed):
                mate, partner, other = listed[(k + 1) % len(listed)], PARTNERS[k % len(PARTNERS)], PARTNERS[(7 * k + 3) % len(PARTNERS)]
                out += [(f"http://{host}/{path}", label) for host, path in ((f"{word}-{partner}.com", ""), (f"{other}-{word}.net", partner), (f"{word}-{mate}.org", f"{mate}/{word}"), (f"{kind}-{word}.com" if label == "allow" else f"{word}.com", word))]
    return out


def lexicon_total(corpus: dict[str, int] | None = None, extra: int = 0) -> float:
    return sum(counted(corpus).values()) + extra


def lexicon(corpus: dict[str, int] | None = None, extra: int = 0) -> dict[str, float]:
    """Word -> log probability; ``extra`` is the count of further corpus words."""
    total = lexicon_total(corpus, extra)
    return {w: math.log(n / total) for w, n in counted(corpus).items()}


def segment(name: str, logp: Mapping[str, float], longest: int) -> list[str]:
    """The most probable words of a concatenated name; ``longest``: letters of the longest known word.

    An unknown stretch may have any length: it costs UNKNOWN and LETTER a letter.
    """
    n = len(name)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    strange, since = -math.inf, 0  # the best way whose last word is unknown so far, and where that begins
    for j in range(1, n + 1):
        if best[j - 1] + UNKNOWN > strange:
            strange, since = best[j - 1] + UNKNOWN, j - 1
        strange += LETTER
        score, start = strange, since
        for i in range(max(0, j - longest), j):
            p = logp.get(name[i:j])
            if p is not None and best[i] + p > score:
                score, start = best[i] + p, i
        best[j], back[j] = score, start
    words, j = [], n
    while j:
        words.append(name[back[j] : j])
        j = back[j]
    return words[::-1]


def tokens(host: str, path: str, logp: Mapping[str, float], longest: int) -> list[str]:
    """Segmented words of host and path; host words are marked."""
    out = []
    for mark, text in (("h:", host), ("p:", path)):
        for piece in PIECE.findall(text.lower()):
            if piece not in PLAIN:
                out += [mark + w for w in segment(piece, logp, longest) if w not in PLAIN]
    return out


def split(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    m = re.search(r"[/?#]", rest)
    host, rest = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    return host, re.split(r"[?#]", rest)[0]


def train(labelled: list[tuple[str, str]] | None = None) -> dict:
    """Multinomial naive Bayes with add-one smoothing; host and path words also count without their mark.

    The words of the training names are apart already, so no lexicon has a part in it.
    """
    apart = lexicon()
    longest = max(map(len, apart))
    counts: dict[str, dict[str, int]] = {"allow": {}, "block": {}}
    n = {"allow": 0, "block": 0}
    for url, label in examples() if labelled is None else labelled:
        n[label] += 1
        for t in tokens(*split(url), apart, longest):
            for x in (t, t[2:]):
                counts[label][x] = counts[label].get(x, 0) + 1
    words = {*counts["allow"], *counts["block"]}
    size = {c: sum(v.values()) + len(words) for c, v in counts.items()}
    ratio = {w: math.log((counts["block"].get(w, 0) + 1) / size["block"]) - math.log((counts["allow"].get(w, 0) + 1) / size["allow"]) for w in words}
    return {"prior": math.log(n["block"]) - math.log(n["allow"]), "ratio": ratio}


def score(words: list[str], model: dict) -> float:
    """Log odds that a site with these words is to be blocked; words that the training didn't see say nothing."""
    return model["prior"] + sum(model["ratio"].get(t, model["ratio"].get(t[2:], 0.0)) for t in words)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, with its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # a longer one overrides
        at, slash, start = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def corpus_words(split_urls: DataFrame) -> DataFrame:
    """(word, n): words that many distinct hosts and paths hold between other characters than letters; counts over all rows.

    Hosts and paths are made distinct first, and counts are added up before they move.
    """
    names = split_urls.select(F.explode(F.array("host", "path")).alias("name")).distinct()
    pieces = names.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]{2,})"), 1))).alias("word"))
    return pieces.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= LEAST_SEEN) & ~F.col("word").isin(*sorted(PLAIN)))


def new_words(seen: DataFrame) -> DataFrame:
    """Without the words that are made up of built-in ones; those stay concatenated, to be segmented."""
    known = lexicon()
    longest = max(map(len, known))

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([any(x not in known for x in segment(w, known, longest)) for w in batch.column(0).to_pylist()], pa.bool_()))

    return seen.mapInArrow(keep, "word string, n long")


def substrings(pieces: Column, longest: int) -> Column:
    """Distinct parts of 2 to ``longest`` letters of an array of pieces."""

    def parts_of(piece):
        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(piece) - 1), lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(longest), F.length(piece) - i + 1)), lambda k: F.substring(piece, i, k))))

    return F.array_distinct(F.flatten(F.transform(pieces, parts_of)))


def with_words(ruled: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """Add ``found``: the corpus words, with counts, that a row's host and path hold anywhere."""
    names = ruled.select("host", "path").distinct()
    pieces = F.concat(*[F.regexp_extract_all(F.lower(c), F.lit("([a-z]{2,})"), 1) for c in ("host", "path")])
    held = names.select("host", "path", F.explode(substrings(pieces, longest)).alias("word")).join(words, "word")
    found = held.groupBy("host", "path").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    return ruled.join(found, ["host", "path"], "left").select(*ruled.columns, "found")


def judge(pages: DataFrame, rules=RULES, corpus: dict[str, int] | None = None, most: int = LEXICON) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, score, words.

    A rule's verdict stands; otherwise a score above zero blocks.  Null urls
    and those without ``://`` have an empty host and path and are allowed unless
    a rule says otherwise.  Repeated rows are judged alike, names of any length
    whole; ties between ways to cut a name go to the longer last word.  Other
    columns aren't read, whatever their names.  An empty table gives no rows.
    The segmenter knows the built-in words and all corpus words (LEAST_SEEN);
    beyond ``most`` of these they are joined to the names instead of sent to all tasks.
    """
    urls = pages.select("page_id", F.col("url").cast("string").alias("__url"))
    host, path = parts(F.col("__url"))
    split_urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split_urls.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    known, joined = lexicon(), False
    longest = max(map(len, known))
    if corpus is None:
        seen = corpus_words(split_urls)
        rows = seen.limit(most + 1).collect()
        joined = len(rows) > most
        corpus = {} if joined else {r["word"]: r["n"] for r in rows}
    known_words = {w: n for w, n in corpus.items() if any(x not in known for x in segment(w, known, longest))}
    longest = max([longest, *map(len, known_words)])
    extra = 0
    if joined:
        words = checkpoint(new_words(seen))
        extra, far = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.length("word")), F.lit(0))).first()
        longest = max(longest, far)
        ruled = with_words(ruled, words, longest)
    else:
        ruled = ruled.withColumn("found", F.lit(None).cast("array<struct<word:string,n:bigint>>"))
    logp = lexicon(known_words, extra)
    total = lexicon_total(known_words, extra)
    model = train()

    def run(batches):
        known: dict[tuple[str, str], tuple[float, str]] = {}
        for batch in batches:
            scores, words = [], []
            for h, p, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist()):
                pieces = tuple(x for x in PIECE.findall(p.lower()))
                if (h, pieces) not in known:
                    if len(known) > 50_000:
                        known.clear()
                    own = ChainMap({x["word"]: math.log(x["n"] / total) for x in found}, logp) if found else logp
                    cut = tokens(h, p, own, longest)
                    known[h, pieces] = score(cut, model), " ".join(t[2:] for t in cut)
                s, w = known[h, pieces]
                scores.append(s)
                words.append(w)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.float64()), pa.array(words, pa.string())], names=[*batch.schema.names[:5], "score", "words"])

    shape = f"page_id {ruled.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, says string, score double, words string"
    judged = ruled.mapInArrow(run, shape)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score", "words")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
