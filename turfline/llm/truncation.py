"""Text cut off by field limits or broken transfers.

Lengths are recomputed under several encodings of the text; per source and encoding, a length at which many texts stop in
the open, with next to none beyond, exposes a storage limit. Endings are then inspected: whether a text that ends without
a closing mark ends where sentences of the corpus end, or in the midst of a word or sentence.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.llm.mixing import source_key
from turfline.session import cut

# The encodings under which a field may have been limited.
ENCODINGS = ("characters", "utf8", "utf16", "entities", "json", "json_ascii", "crlf", "crlf_utf8")
#: A limit is a length with at least LEAST open texts, SPIKE times as many as lengths below it, and at most BEYOND of them longer.
LEAST, SPIKE, BEYOND, SOFT = 4, 8.0, 0.1, 16
#: Texts without closing mark end a sentence if a share of at least ENDS of their last words' occurrences do; near a soft limit, SURE.
ENDS, SURE = 0.05, 0.8
#: Contexts kept in a Python worker before they are handed on, most contexts asked for that are broadcast, and most rows of
#: signatures and of sources with limits; beyond these, joins shuffle.
HELD, ASKED, SMALL = 400_000, 500_000, 100_000

WORD = re.compile(r"([^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,]\d+)*)")
ELLIPSIS = re.compile(r"\s*(?:\.\.\.+|…)\s*$")
CLOSED = re.compile(r"(?:[.!?。]+[\"'”’»)\]\s]*|[”»])$")
DOTS = re.compile(r"(?:\.\.\.+|…)\s*$")
BROKEN = re.compile(r"(?:&(?:#?\w{0,8})|�+|\\u?[0-9a-fA-F]{0,3}|</?[a-zA-Z][^<>]{0,30}|<)$")
HANGING = re.compile(r"[,;:(«/\\&·–—-]$")
ORNAMENT = re.compile(r"(?:\[\w+\]|#\w+|\s[:;][-']?[)(DP]|[^\w\s.,;:!?…'\"”’»«()\[\]/\\&%+=<>@#*$€£°·–—�-])\s*$")
SIGNED = r"^\s*(?:--|—|–|\(.*\)\s*$|\[.*\]\s*$|#\w+\s*$)"
MOJIBAKE = re.compile(r"[Â-Å][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")


def repaired(text: str) -> str:
    """Without markup and entities, and with UTF-8 that was read as a one-byte code page read again."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = re.sub(r"</?\w[^<>]{0,60}>", " ", text)

    def again(m: re.Match) -> str:
        for page in ("cp1252", "latin-1"):
            try:
                return m.group().encode(page).decode("utf-8")
            except UnicodeError:
                pass
        return m.group()

    return MOJIBAKE.sub(again, text) if re.search("[Â-Å]", text) else text


@lru_cache(100_000)
def gap(between: str) -> tuple[bool, bool]:
    """Of what stands between two words: whether a sentence ends before it, and whether one begins after it."""
    return bool(re.match(r"[\"'”’»)]*(?:[.!?…]|\s*\n)", between)), bool(re.search(r"[.!?\n…]", between))


@lru_cache(300_000)
def kind(word: str, first: bool) -> str:
    """Class of a word: numbers are one, and capitalised words inside a sentence another."""
    return "0" if word[0].isdigit() else "N" if word[0].isupper() and not first else word.lower()


def kinds(text: str) -> tuple[list[str], list[str], list[bool]]:
    """Classes of the words of a text, the words, and whether a sentence ends after each."""
    parts = WORD.split(text)
    words, gaps = parts[1::2], [gap(g) for g in parts[::2]]
    classes = [kind(w, i == 0 or gaps[i][1]) for i, w in enumerate(words)]
    return classes, words, [g[0] for g in gaps[1:]]


def contexts(classes: list[str], words: list[str], i: int) -> list[str]:
    """Keys of the last one, two and three classes up to word i, and of the word itself if it is a name."""
    k = classes[max(0, i - 2) : i + 1]
    keys = ["1 " + k[-1], "2 " + " ".join(k[-2:]), "3 " + " ".join(k)]
    return [*keys, "w " + words[i]] if k[-1] == "N" else keys


def signature(line: str) -> bool:
    """Whether a last line by itself is a signature: dashed, bracketed or a hash tag."""
    return bool(re.match(SIGNED, line))


def ending(text: str, signatures: frozenset[str]) -> tuple[str, str]:
    """How a text ends and the text up to there: ``none``, ``closed``, ``open``, ``ellipsis`` or ``broken``."""
    body = text.rstrip()
    if not body:
        return "none", ""
    if BROKEN.search(body[-40:]) and not re.search(r"&\w{1,8};$", body):
        return "broken", body
    body = repaired(body).rstrip()
    head, _, last = body.rpartition("\n")
    if head.strip() and (signature(last) or last.strip() in signatures) or ORNAMENT.search(body[-60:]):
        return "closed", body  # something stands after the text proper
    tail = body[-400:]  # endings are short; texts may be long
    if dots := ELLIPSIS.search(tail):
        body, kind = body[: len(body) - len(tail) + dots.start()], "ellipsis"
    elif re.search(r"\d\.$", tail):
        body, kind = body[:-1], "open"
    else:
        kind = "closed" if CLOSED.search(tail) else "open"
    return ("broken" if kind != "closed" and HANGING.search(body[-2:]) else kind), body


def broadcast_if_small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """The same rows, to be broadcast if they are at most ``most``."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def last_line(text: str) -> Column:
    """A short last line without closing mark below a closed text; else empty."""
    return F.trim(F.regexp_extract(F.rtrim(F.col(text)), r"[.!?…]\s*\n([^\n]{1,40})$", 1))


def common_signatures(documents: DataFrame, text: str = "text", least: int = 5) -> DataFrame:
    """``line``: short last lines that stand without closing mark below ``least`` or more different paragraphs, and seldom
    (``BEYOND``) begin a longer line of the corpus, as the first words of a paragraph do that was cut."""
    above = F.xxhash64(F.regexp_extract(F.rtrim(F.col(text)), r"([^\n]*[.!?…])\s*\n[^\n]{1,40}$", 1))
    lines = documents.select(last_line(text).alias("line"), above.alias("above")).filter("line <> ''").filter(~F.col("line").rlike(r"[.!?…]$"))
    lines = cut(lines.groupBy("line").agg(F.count_distinct("above").alias("n")).filter(F.col("n") >= least).filter(~F.col("line").rlike(SIGNED)))
    sizes = [r[0] for r in lines.select(F.length("line")).distinct().collect()]  # at most 40
    each = documents.select(F.explode(F.split(text, "\n")).alias("l")).select(F.left(F.regexp_replace(F.trim("l"), r"[.!?…\s]+$", ""), F.lit(41)).alias("l"))
    heads = each.select("l", F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")).alias("size")).filter(F.length("l") > F.col("size"))
    heads = heads.select(F.expr("left(l, size)").alias("line")).join(broadcast_if_small(lines.select("line")), "line", "left_semi")  # few lines begin like one
    longer = heads.groupBy("line").agg(F.count("*").alias("longer"))
    return lines.join(longer, "line", "left").filter(F.coalesce("longer", F.lit(0)) <= BEYOND * F.col("n")).select("line")


def with_signature(documents: DataFrame, signatures: DataFrame, text: str = "text") -> DataFrame:
    """Documents and the ``signature`` that their text ends in, or null. Texts without such a line are spread over the join."""
    key = F.when(last_line(text) != "", last_line(text)).otherwise(F.concat(F.lit("\n"), F.xxhash64(text).cast("string")))
    signatures = broadcast_if_small(signatures)
    return documents.withColumn("__line", key).join(signatures.select(F.col("line").alias("__line"), F.col("line").alias("signature")), "__line", "left").drop("__line")


def lengths(text: str) -> list[int]:
    """Lengths of a text under ``ENCODINGS``."""
    lines, size = text.count("\n"), len(text)
    utf8 = len(text.encode("utf-8", "surrogatepass"))
    escaped = lines + text.count('"') + text.count("\\") + text.count("\t") + text.count("\r")
    wide = sum(c > "\uffff" for c in text)
    foreign = 0 if text.isascii() else sum(c > "\x7f" for c in text)
    marks = 4 * text.count("&") + 3 * text.count("<") + 3 * text.count(">") + 5 * text.count('"') + 4 * text.count("'")
    return [size, utf8, size + wide, size + marks, size + escaped, size + escaped + 5 * foreign + 6 * wide, size + lines, utf8 + lines]


def examined(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document ``with_signature``: ``doc``, ``source`` key, ``state`` of its ending, ``lens`` under the encodings, ``keys`` of its last words."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            states, lens, keys, last = [], [], [], []
            for t, own in zip(batch["t"], batch["signature"], strict=True):
                state, body = ending(t or "", frozenset({own}))
                classes, words, _ = kinds(body[-200:]) if state in ("open", "ellipsis") else ([], [], [])
                if state in ("open", "ellipsis") and not words:
                    state = "none"
                states.append(state)
                lens.append(lengths(t[:-400] + DOTS.sub("", t[-400:]) if state == "ellipsis" else t or ""))
                own = contexts(classes, words, len(words) - 1) if words else []
                before = [("q", "1 " + classes[-2])] if len(words) > 1 else []
                keys.append([{"o": o, "key": k} for o, k in [*((k[0], k) for k in own), *before]])
                last.append(classes[-1] if words else "")
            yield pd.DataFrame({"doc": batch["doc"], "source": batch["source"], "state": states, "lens": lens, "keys": keys, "last": last})

    kind = dict(documents.dtypes)[doc]
    rows = documents.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), source_key(F.col(source)).alias("source"), F.col(text).alias("t"), "signature")
    return rows.mapInPandas(look, f"doc {kind}, source string, state string, lens array<int>, keys array<struct<o:string,key:string>>, last string")


def by_last(keys: Iterable[str]) -> dict[str, tuple[list[str], dict, dict]]:
    """Keys of contexts by their last class: that of the class alone, those of two classes by the one before, and those of
    three by the two before. A longer context is only there with the shorter one."""
    out: dict[str, tuple[list[str], dict, dict]] = {}
    for key in keys:
        parts = [None, None, *key[2:].split(" ")]
        if key[0] != "w":
            own = out.setdefault(parts[-1], ([], {}, {}))
            if key[0] == "1":
                own[0].append(key)
            else:
                own[int(key[0]) - 1][parts[-2] if key[0] == "2" else (parts[-3], parts[-2])] = key
    return out


def sentence_ends(documents: DataFrame, asked: DataFrame, text: str = "text") -> DataFrame:
    """``key``, ``n``, ``ends``: how often the contexts ``asked`` for (``key``) occur in the corpus, and how often a sentence ends
    there; and the same of every name, a key that begins with ``w``.

    The last word of a text without closing mark isn't counted. Contexts asked for are broadcast if there are at most
    ``ASKED``, and no others are counted then; counts are summed per batch of a task before the shuffle.
    """
    wanted = None
    if asked.limit(ASKED + 1).count() <= ASKED:
        wanted = documents.sparkSession.sparkContext.broadcast(frozenset(r["key"] for r in asked.collect()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        e: Counter = Counter()
        table = by_last(wanted.value) if wanted else None
        for batch in batches:
            for t, own in zip(batch["t"], batch["signature"], strict=True):
                state, _ = ending(t or "", frozenset({own}))
                classes, words, ends = kinds(repaired(t or ""))
                two = one = None  # the classes before
                for i in range(len(words) - (state in ("open", "ellipsis", "broken"))):
                    c = classes[i]
                    if table is None:
                        keys = contexts(classes, words, i)
                    else:
                        keys = ["w " + words[i]] if c == "N" else []
                        if (of := table.get(c)) is not None:
                            keys += of[0]
                            if (key := of[1].get(one)) is not None:
                                keys.append(key)
                                if (key := of[2].get((two, one))) is not None:
                                    keys.append(key)
                    for key in keys:
                        n[key] += 1
                        if ends[i]:
                            e[key] += 1
                    two, one = one, c
            if len(n) > HELD:
                yield pd.DataFrame([(k, c, e[k]) for k, c in n.items()], columns=["key", "n", "ends"])
                n.clear()
                e.clear()
        yield pd.DataFrame([(k, c, e[k]) for k, c in n.items()], columns=["key", "n", "ends"])

    rows = documents.select(F.col(text).alias("t"), "signature").mapInPandas(count, "key string, n long, ends long")
    rows = rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    if wanted is None:
        names = rows.filter(F.col("key").startswith("w "))
        return rows.filter(~F.col("key").startswith("w ")).join(asked, "key", "left_semi").unionByName(names)
    return rows


def limits(seen: DataFrame) -> DataFrame:
    """Hidden limits: ``source``, ``encoding``, ``low``, ``high`` (texts of these lengths stop at the limit), ``hard``, ``open_texts``.

    Lengths of texts are counted per source and encoding before the shuffle. A hard limit is a length at which far more
    open texts stop than at lengths below and next to none is longer; a soft one, where texts are cut between words, is
    such a range of ``SOFT`` lengths.
    """
    open_text = F.col("state").isin("open", "ellipsis", "broken").cast("int")
    each = seen.select("source", open_text.alias("o"), F.posexplode("lens").alias("encoding", "len"))
    by = each.groupBy("source", "encoding", "len").agg(F.sum("o").alias("o"), F.count("*").alias("n"))
    w = Window.partitionBy("source", "encoding").orderBy("len")
    longer = F.coalesce(F.sum("n").over(w.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    below = F.coalesce(F.sum("o").over(w.rangeBetween(-216, -SOFT - 1)), F.lit(0)) / 200
    near = F.sum("o").over(w.rangeBetween(-SOFT + 1, 0))
    by = by.select("*", longer.alias("longer"), below.alias("below"), near.alias("near"))
    hard = (F.col("o") >= LEAST) & (F.col("o") >= SPIKE * F.col("below")) & (F.col("longer") <= BEYOND * F.col("o"))
    soft = (F.col("near") >= 2 * LEAST) & (F.col("near") >= SPIKE * SOFT * F.col("below") / 2) & (F.col("longer") <= BEYOND * F.col("near")) & F.col("encoding").isin(0, 1)
    name = F.element_at(F.array(*[F.lit(x) for x in ENCODINGS]), F.col("encoding") + 1)
    slack = F.when(name.isin("utf8", "crlf_utf8"), 3).otherwise(0)  # a cut steps back to a whole character
    tight = by.filter(hard).select("source", "encoding", (F.col("len") - slack).alias("low"), F.col("len").alias("high"), F.lit(True).alias("hard"), F.col("o").alias("open_texts"))
    loose = by.filter(soft).groupBy("source", "encoding").agg(F.max("len").alias("high"), F.max("near").alias("open_texts"))
    loose = loose.join(tight.select("source").distinct(), "source", "left_anti")
    loose = loose.select("source", "encoding", (F.col("high") - SOFT + 1).alias("low"), "high", F.lit(False).alias("hard"), "open_texts")
    return tight.unionByName(loose)


def truncated(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """All documents with ``doc``, ``source`` key, ``state``, ``at_limit`` and ``cut``, and the limits found.

    A text is cut if it ends in a broken entity, character or mark of a list; if it stops without closing mark at a hard
    limit of its source; or if it ends without closing mark, or with an ellipsis, where words or sentences of the corpus
    don't end. Null and empty texts aren't cut; rows with a null id are left out; repeated rows are judged alike, and ids
    must be unique otherwise; null sources are one source.
    """
    documents = with_signature(documents.select(doc, text, source), cut(common_signatures(documents, text)), text)
    seen = cut(examined(documents, doc, text, source))
    # only contexts in which an open text ends, and single words before them, are counted in the corpus
    contexts_asked = cut(seen.filter(F.size("keys") > 0).select(F.explode("keys.key").alias("key")).distinct())
    corpus = cut(sentence_ends(documents, contexts_asked, text))
    found = cut(limits(seen))
    # whether a capitalised word that is seen nowhere else has the ending of a whole one
    whole = corpus.filter(F.col("key").rlike(r"^w \p{Lu}") & (F.col("n") >= 2)).select(F.expr("substring(key, 3)").alias("w")).filter("length(w) >= 6")
    gram = whole.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.length("w") - 3), lambda i: F.substring("w", i, F.lit(4)))).alias("i", "g"), (F.length("w") - 4).alias("at"))
    tails = gram.groupBy("g").agg(F.avg((F.col("i") == F.col("at")).cast("double")).alias("tail"))
    asked = seen.filter(F.size("keys") > 0).select("doc", "last", F.explode("keys").alias("k")).select("doc", "last", "k.o", "k.key")
    known = asked.join(corpus, "key", "left")
    pick = lambda o, c: F.max(F.when(F.col("o") == o, F.coalesce(c, F.lit(0))))
    known = known.groupBy("doc", "last").agg(
        *[pick(o, c).alias(f"{c}{o}") for o in "123" for c in ("n", "ends")], pick("w", "n").alias("word"), pick("q", "n").alias("before"),
        F.max(F.when(F.col("o") == "w", F.expr("right(key, 4)"))).alias("g"),
    )
    known = known.join(tails, "g", "left")
    share = F.when(F.col("n3") >= 5, F.col("ends3") / F.col("n3")).when(F.col("n2") >= 5, F.col("ends2") / F.col("n2"))
    share = share.when(F.col("n1") >= 5, F.col("ends1") / F.col("n1")).otherwise(0.0)
    whole_word = F.when(F.col("last") == "N", (F.col("word") >= 2) | (F.coalesce("tail", F.lit(0.0)) >= 0.5)).when(F.col("last") == "0", True)
    # a word that never follows the one before it, though that one is common, is the beginning of another
    whole_word = whole_word.otherwise((F.col("n1") >= 3) & ~((F.col("n2") == 0) & (F.coalesce("before", F.lit(0)) >= 200)))
    known = known.select("doc", share.alias("share"), whole_word.alias("whole_word"))
    # the limits of a source in one row, so that every text is compared with those of its source in place
    ranges = broadcast_if_small(found.groupBy(F.col("source").alias("ls")).agg(F.collect_list(F.struct("encoding", "low", "high", "hard")).alias("ranges")))
    at = F.filter("ranges", lambda l: F.get("lens", l["encoding"]).between(l["low"], l["high"]))
    hard = F.when(F.col("state").isin("open", "ellipsis", "broken") & (F.size(at) > 0), F.exists(at, lambda l: l["hard"]))
    judged = seen.join(ranges, F.col("source") == F.col("ls"), "left").withColumn("hard", hard).join(known, "doc", "left")
    unsure = F.col("state").isin("open", "ellipsis")
    complete = F.coalesce(F.col("whole_word") & (F.col("share") >= F.when(F.col("hard").isNotNull(), SURE).otherwise(ENDS)), F.lit(False))
    is_cut = (F.col("state") == "broken") | (unsure & (F.coalesce("hard", F.lit(False)) | ~complete))
    judged = judged.select(F.col("doc").alias(doc), F.col("source").alias(source), "state", F.col("hard").isNotNull().alias("at_limit"), is_cut.alias("cut"))
    return judged, found
