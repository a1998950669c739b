"""License scan: TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

A file's whole text, and the comment it begins with, are compared with the whole texts and notices of licences; its sentences, also
those that run over line breaks and comment marks, and its lines, with the sentences that grant or announce one. Each comparison is
the cosine of sparse TF-IDF vectors over template words and the count of other words; lines of copyright are left out. A passage
that names versions is compared only with templates that name one of them or none; a line with identifiers (SPDX), of lines of that kind only with those of one of
its identifiers. Sentences to compare with are grants, titles of licences and lines with identifiers. Inverse document frequencies are counted over
the sentences of all files. A match of the whole text or header goes before one of a sentence, since licences share sentences.
A file named as a licence file, or one that is for the most part matched text, gives its licence to its directory. A file without a
licence of its own takes that of the nearest directory above it that has one.

What cannot reach the least cosine is told without one: a vector that lacks the rarest words of a template, up to where the
others are shorter than the least cosine, cannot reach it. This drops no match.

Null and empty texts have no licence of their own, but inherit. A file with a null path never inherits. Repeated rows are all
kept. The best match wins; ties go to the template that sorts first, and in a directory to the path that does. Texts are whole at any
length. An empty table gives no rows. Columns other than key, path and text are left out, so their names clash with nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import in_batches, maybe_broadcast, saved
from tidewater.llm.license_texts import SENTENCES, TEXTS

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"\n|(?<=[.!?])\s+")
#: Ends of sentences where lines go on; marks of comments at the start of a line.
WRAPPED = re.compile(r"\n(?:[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+)?[ \t\r]*\n)+|(?<=[.!?])\s+")
MARKS = re.compile(r"\s*\n[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+)?[ \t]*")
VERSION = re.compile(r"\b(?:versions?|v\.?|licen[sc]e-?|by(?:-\w+)*|cc0|universal|international|attribution(?:-\w+)*)\s*(\d+(?:\.\d+)*)|\b(\d)-clause", re.I)
#: A licence expression after its marker, and the identifiers in it.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]+)", re.I)
IDENTIFIER = re.compile(r"(?<![\w.+-])(?!(?:and|or|with)(?![\w.+-]))[A-Za-z0-9][\w.+-]*", re.I)
#: A line of copyright, and the comment that a file begins with.
COPYRIGHT = re.compile(r"^[^\w\n]*(?:copyright|\(c\)|©)[^\n]*$", re.I | re.M)
HEADER = re.compile(r"(?:[ \t\r]*(?:(?:#|//|/?\*|--|;|%)[^\n]*)?(?:\n|\Z))+")
FILE_NAME = r"(?i)^(un)?licen[sc]e|^copying|^notice"
LEAST_COSINE, LEAST_FILE_SHARE = 0.75, 0.5


def versions(sentence: str) -> frozenset[str]:
    """Versions that a sentence names; 2.0 is 2. Of a line that names licences by their identifiers, these."""
    if identified := SPDX.search(sentence):
        return frozenset(f"spdx:{x.lower()}" for x in IDENTIFIER.findall(identified[1]))
    return frozenset(re.sub(r"(\.0)+$", "", a or b) for a, b in VERSION.findall(sentence))


def template_counts(templates: dict[str, list[str]]) -> list[tuple[str, Counter, frozenset[str]]]:
    return [(name, Counter(WORD.findall(s.lower())), versions(s)) for name, texts in sorted(templates.items()) for s in texts]


PASSAGES = {name: [text] for name, text in TEXTS.items()}
VOCABULARY = frozenset(w for kind in (SENTENCES, PASSAGES) for _, c, _ in template_counts(kind) for w in c)


def _sentences(text: str) -> Iterator[str]:
    return (s for s in SENTENCE.split(text) if s and not s.isspace())


def sentence_frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Sentences in all files, and in how many of them each template word is."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = Counter()
            for text in frame["text"].dropna():
                for s in _sentences(text.lower()):
                    found[""] += 1
                    found.update(VOCABULARY.intersection(WORD.findall(s)))
            yield pd.DataFrame(list(found.items()), columns=["word", "n"])

    rows = in_batches(files.select("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found.pop("", 0), found


def pieces(text: str) -> Iterator[tuple[str, list[str]]]:
    """The sentences of a text with their lines joined, and of those that had several lines, each line's sentences."""
    for whole in WRAPPED.split(text):
        yield MARKS.sub(" ", whole), [*_sentences(whole)] if "\n" in whole else []


def passages(text: str) -> list[str]:
    """The whole text and the comment it begins with, without lines of copyright."""
    header = HEADER.match(text)
    found = [text] if header is None or not header[0].strip() or header.end() == len(text) else [text, header[0]]
    return [COPYRIGHT.sub("", p) for p in found]


class Matcher:
    """Cosines of texts to templates; a word outside the templates weighs as much as one never seen."""

    def __init__(self, total: int, frequency: dict[str, int]):
        self.other = math.log(total + 2)
        self.idf = {w: math.log((total + 2) / (frequency.get(w, 0) + 1)) + 0.1 for w in VOCABULARY}
        self.sentences, self.passages = ([(name, self._unit(c), named) for name, c, named in template_counts(kind)] for kind in (SENTENCES, PASSAGES))
        self.needed = frozenset(w for kind in (self.sentences, self.passages) for _, t, _ in kind for w in self._prefix(t))

    def _unit(self, counts: Counter) -> dict[str, float]:
        weights = {w: n * self.idf[w] for w, n in counts.items() if w in self.idf}
        others = sum(n * n for w, n in counts.items() if w not in self.idf)
        norm = math.sqrt(sum(x * x for x in weights.values()) + others * self.other**2) or 1.0
        return {w: x / norm for w, x in weights.items()}

    def _prefix(self, template: dict[str, float]) -> Iterator[str]:
        """The rarest words, up to where the length of the others is under the least cosine."""
        left = 1.0
        for w, x in sorted(template.items(), key=lambda e: (-self.idf[e[0]], e[0])):
            if left < (LEAST_COSINE - 1e-6) ** 2:
                return
            yield w
            left -= x * x

    def best(self, text: str, templates: list[tuple[str, dict[str, float], frozenset[str]]]) -> tuple[float, str]:
        """The largest cosine, negative, and its template; (0, '') where none reaches the least cosine."""
        words = WORD.findall(text.lower())
        if self.needed.isdisjoint(words):
            return 0.0, ""
        vector, said = self._unit(Counter(words)), versions(text)
        fit = ((-round(sum(x * vector[w] for w, x in t.items() if w in vector), 9), name) for name, t, named in templates if not said or not named or said & named)
        found = min(fit, default=(0.0, ""))
        return found if -found[0] >= LEAST_COSINE else (0.0, "")


def own_licenses(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, license, cosine, share (of the file's words that matched) for every row; null where nothing matched."""
    matcher = Matcher(*sentence_frequencies(files))

    def one(text: str | None) -> tuple[str | None, float | None, float]:
        words = WORD.findall(text.lower()) if isinstance(text, str) else []
        if matcher.needed.isdisjoint(words):
            return None, None, 0.0
        found, most = [], 0
        for p in passages(text):
            best = matcher.best(p, matcher.passages)
            if best[1]:
                found.append((0, *best))
                most = max(most, len(WORD.findall(p)))
        matched = 0

        def look(s: str) -> int:
            """Words of a sentence that matches, else 0."""
            best = matcher.best(s, matcher.sentences)
            if not best[1]:
                return 0
            found.append((1, *best))
            return len(WORD.findall(s))

        for joined, lines in pieces(text):
            of_lines = sum(look(s) for s in lines)
            matched += look(joined) or of_lines
        if not found:
            return None, None, 0.0
        _, cosine, name = min(found)
        return name, -cosine, min(1.0, max(matched, most) / len(words))

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([one(text) for text in frame["text"]], columns=["license", "cosine", "share"], dtype=object)
            yield pd.concat([frame[keys].reset_index(drop=True), out], axis=1)

    picked = files.select(*keys, "text")
    return in_batches(picked).mapInPandas(match, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in picked.schema if f.name != 'text')}, license string, cosine double, share double")


def scan_licenses(files: DataFrame, key: str = "doc_id", path: str = "path") -> DataFrame:
    """key, path, license, cosine, origin ('own', 'inherited' or null), from_directory for every row."""
    own = saved(own_licenses(files.select(key, path, "text"), [key, path]), "licenses")
    name, folder = F.substring_index(path, "/", -1), F.regexp_replace(path, "/?[^/]*$", "")
    givers = own.filter(F.col("license").isNotNull() & F.col(path).isNotNull() & (name.rlike(FILE_NAME) | (F.col("share") >= LEAST_FILE_SHARE)))
    by_folder = givers.groupBy(folder.alias("folder")).agg(F.min_by("license", F.struct(-F.col("cosine"), path)).alias("given"))
    # all directories above those in use: few beside the files, so ancestors are joined for them and not for files
    folders = own.filter(F.col(path).isNotNull()).select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = folders.select(F.col("folder").alias("below"), F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))).alias("a")).select("below", "a.*").distinct()
    nearest = above.join(by_folder, "folder").groupBy("below").agg(F.max(F.struct("depth", "folder", "given")).alias("n")).select("below", F.col("n.folder").alias("from_directory"), F.col("n.given").alias("given"))
    # written, so that Spark can split the rows of a directory that holds very many
    joined = own.join(maybe_broadcast(saved(nearest, "nearest")), folder == F.col("below"), "left")
    mine = F.col("license").isNotNull()
    origin = F.when(mine, "own").when(F.col("given").isNotNull(), "inherited")
    return joined.select(key, path, F.coalesce("license", "given").alias("license"), "cosine", origin.alias("origin"), F.when(~mine, F.col("from_directory")).alias("from_directory"))
