"""Secret scan: base patterns, and novelty of candidates under dictionary-primed zstandard."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import string
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm.common import map_column, rewrite_texts, table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 and more are the leftmost matches of [0-9a-f]+ that are long enough.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: What makes a context sensitive for the novelty test, besides WORDS.
CONTEXT = (*WORDS, "credential", "bearer", "passphrase", "private_key", "private key", "privatekey", "access_key", "access key", "accesskey", "authorization", "signing", "pwd")
SENSITIVE = re.compile("(?ai:(?:" + "|".join(CONTEXT) + ")+)")  # words that follow one another are one context
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: A candidate starts at most so many characters after a sensitive word; so much text around it primes the compressor.
REACH, AROUND = 64, 512
#: Marginal compressed bytes for each character from which a candidate is reported.  A letter that no match covers takes about 6 bits.
NOVELTY = 0.65
#: Before the surroundings in each frame, so that every frame codes its literals alike, however few they are: base64 of fixed hashes.
PRIMER = base64.b64encode(b"".join(hashlib.sha256(bytes([k])).digest() for k in range(40)))
IDENTIFIERS = (
    "abstract access account action active address admin algorithm allocate alpha append application argument array assert async attribute authentication authorization "
    "background backup base64 batch boolean bootstrap boundary branch buffer builder button bytes cache calculate callback cancel certificate channel character checkpoint checksum "
    "class client cluster collection column command comment commit common compile component config configuration connection console constant constructor container content context "
    "controller convert cookie counter create credential current cursor database dataframe datetime debug decode decorator default define delete dependency deploy description "
    "destination destroy device dictionary directory disable document domain download driver dynamic element enable encode encrypt endpoint engine entity environment error event "
    "example exception execute executor expire export expression extension factory failure feature fetch field filename filter finally float folder format forward fragment framework "
    "function gateway generate generator getattr global graph group handle handler hash header height hidden history host identifier identity image implement import include index "
    "information initialize inline input insert install instance integer interface internal interval invalid invoke isinstance iterator javascript kernel keyboard keyword lambda language "
    "layout length library license limit listener literal loader local location logger login logout manager manifest master matrix maximum member memory message metadata method metric "
    "middleware migration minimum mobile model module monitor multiple mutable namespace navigation network notification null number object offset operator option order original output "
    "package packet parameter parent parse partition password path pattern payload permission pipeline placeholder platform plugin pointer policy port position prefix primary print "
    "private process processor production profile program project promise properties property protocol provider proxy public publish pull push python query queue random range reader "
    "receive record redirect reference refresh register registry release remote remove render repeat replace replica repository request require reset resolve resource response "
    "restart result return reverse revision rollback root route router routine runtime sample scheduler schema scope script search secret section security segment select self sequence "
    "serialize server service session setting setup shared shuffle signal signature simple single snapshot socket source spark standard start state statement static status storage "
    "stream string struct subject submit subscribe success suffix summary support switch symbol sync syntax system table target task template temporary terminal test text thread "
    "threshold timeout timestamp title token topic trace transaction transform transport trigger tuple type undefined unicode unique update upload username utility validate value "
    "variable vector vendor verbose verify version virtual visible volume warning webhook widget width window worker workflow wrapper write yield 0123456789 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ example_value changeme placeholder your_token_here xxxxxxxxxxxx"
)

#: Ordinary words of several languages; with IDENTIFIERS they give the letter pairs that words are made of.
ORDINARY = (
    "the and that have with this from they will would there their what about which when make like time just know take people into year your good some could them than then look only come over "
    "think also back after work first well even want because these give most information international development government environment management organization communication responsibility "
    "understanding characteristic administration establishment straightforward university knowledge relationship performance available different important experience technology application "
    "der die und das ist nicht ein eine mit von sich auf auch nach wird bei einer durch kann haben werden oder aber noch zwischen immer wieder schon unter gegen diese jahre zeit arbeit entwicklung "
    "verantwortung gesellschaft wissenschaft unternehmen verwaltung benutzer einstellung moeglichkeit geschwindigkeit zusammenarbeit beschreibung sicherheit schluessel unabhaengig veroeffentlichung "
    "les des est une que dans pour pas sur avec tout plus son qui sont mais comme nous vous leur elle faire etre deux aussi bien sans peut ces annees temps developpement gouvernement environnement "
    "connaissance responsabilite utilisateur administration entreprise societe naturellement particulierement aujourd beaucoup toujours chaque quelque question travail monde nouveau grande pensee "
    "los las del que por con para una como mas pero sus este cuando muy sin sobre tambien hasta hay donde quien desde todo nos durante todos uno ella entre ser otros fue tiempo desarrollo gobierno "
    "conocimiento responsabilidad usuario administracion empresa sociedad naturalmente universidad informacion comunicacion trabajo mundo nuevo contrasena seguridad aplicacion investigacion siempre"
)


def _letter_pairs() -> dict[str, float]:
    """Bits that a letter takes after the one before it, for pairs in words; unseen pairs have a tenth of a count."""
    n, after = {}, {}
    for word in re.findall("[a-z]+", (ORDINARY + " " + IDENTIFIERS.replace("abcdefghijklmnopqrstuvwxyz", "").replace("xxxxxxxxxxxx", "")).lower()):
        for a, b in zip(word, word[1:]):
            n[a + b], after[a] = n.get(a + b, 0) + 1, after.get(a, 0) + 1
    return {a + b: -math.log2((n.get(a + b, 0) + 0.1) / (after.get(a, 0) + 2.6)) for a in string.ascii_lowercase for b in string.ascii_lowercase}


PAIRS = _letter_pairs()
#: Letters that take so many bits each, by their pairs, aren't words (even letters: log2 26 = 4.7 bits and more).
WORD_BITS = 5.0


def of_words(piece: str) -> bool:
    """Whether a run is made of words, as identifiers, paths and prose are; numbers may stand between them."""
    if sum(a.isdigit() != b.isdigit() for a, b in zip(piece, piece[1:]) if a.isalnum() and b.isalnum()) > 2:
        return False
    bits = [PAIRS[part[k : k + 2]] for part in re.findall("[a-z]+", piece.lower()) for k in range(len(part) - 1)]
    if not bits:
        return not any(map(str.isalnum, piece))
    return sum(bits) / len(bits) < WORD_BITS and 2 * sum(map(str.isdigit, piece)) <= len(piece)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    spans = []
    low = text.encode("utf-8", "replace").lower()
    if b"password" in low or b"passwd" in low or b"secret" in low or b"token" in low or b"api_key" in low or b"apikey" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class Novelty:
    """Marginal compressed bytes of a string after its surroundings and the identifier dictionary."""

    def __init__(self) -> None:
        import zstandard

        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False).compress

    def per_character(self, text: str, start: int, end: int) -> float:
        around = PRIMER + (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode("utf-8", "replace")
        piece = text[start:end].encode("utf-8", "replace")
        return (len(self.compress(around + piece)) - len(self.compress(around))) / len(piece)

    def spans(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """All candidates after a sensitive word that overlap no base span, aren't made of words only and don't compress.  ``known`` is sorted."""
        low = text.encode("utf-8", "replace").lower()
        if not any(w.encode() in low for w in CONTEXT):
            return []
        starts, ends = [s for s, _, _ in known], list(accumulate((e for *_, e in known), max))
        found, tried, run, reported = [], set(), (0, 0), set()
        for m in SENSITIVE.finditer(text):
            for c in CANDIDATE.finditer(text, m.end(), m.end() + REACH + LEAST):
                start = c.start()
                if start in tried:
                    continue
                tried.add(start)
                if not run[0] <= start < run[1]:  # it may go on beyond what was searched
                    run = (start, CANDIDATE.match(text, start).end())
                end = run[1]
                k = bisect_left(starts, end)
                if end in reported or k and ends[k - 1] > start:
                    continue
                piece = text[start:end]
                if not of_words(piece) and self.per_character(text, start, end) >= NOVELTY:
                    found.append((start, 3, end))
                    reported.add(end)
        return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Positions are code points, the end exclusive; a span is the whole match.
    Novel spans are runs of at least LEAST characters, with or without digits,
    that start at most REACH characters after a sensitive word and, primed by
    AROUND characters on either side and the dictionary, still take NOVELTY bytes
    a character; after a reported one a run isn't looked at again.  Runs without
    digits whose letter pairs are those of words aren't reported.
    Null and empty texts have none; very long ones are scanned whole, repeated
    rows alike.  Other columns aren't read, whatever their names.  An empty
    table gives no rows.
    """

    def make():
        novelty = Novelty()

        def run(texts):
            rows = []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                more = novelty.spans(t, base)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                rows.append((*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
            columns = list(zip(*rows)) if rows else [()] * 6
            return [*(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])]

        return run

    out = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return map_column(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", out, make, drop=True)


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """Every document, with its secrets replaced by ``mark``; overlapping spans are one.  Nulls stay null."""

    def make():
        novelty = Novelty()

        def clean(text):
            if text is None:
                return None
            base = base_spans(text)
            spans = sorted(base + novelty.spans(text, base))
            if not spans:
                return text
            parts, at, end = [], 0, -1
            for s, _, e in spans:
                if s >= end:
                    if end >= 0:
                        at = end
                    parts += [text[at:s], mark]
                    end = e
                end = max(end, e)
            return "".join([*parts, text[end:]])

        return lambda texts: ([clean(t) for t in texts], [True] * len(texts))

    return rewrite_texts(docs, make)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
