"""Language identification by compression.

Each language has a zstandard raw-content dictionary of training text. A text is encoded, whole and in windows, once
with each dictionary; the language whose dictionary gives the fewest bytes wins. A narrow margin between the best two
marks the row as rejected.
"""

from __future__ import annotations

import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import map_rows

_LETTER = regex.compile(r"\p{L}")
# ASCII: capitals to small letters, everything that is no letter to a space.
_ASCII = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalized(text: str) -> bytes:
    """Lower case, ASCII digits and punctuation as spaces, runs of spaces as one; between two spaces."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_ASCII).split()) + b" "


def fit(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 96, piece_bytes: int = 1024, dict_bytes: int = 49152, max_langs: int = 256) -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of labelled rows.

    The bound: docs_per_lang rows of each of at most max_langs languages, those with the smallest hash of their id,
    and of each the piece_bytes in the middle, up to dict_bytes a language. Texts are cut and rows limited on the
    executors, so that the driver gets no more than that many characters, however long or often repeated a row is. Rows with a null id or language and texts
    without letters teach nothing. More languages than max_langs is an error.
    """
    key, chars = F.xxhash64(F.col(id_col)), 2 * piece_bytes
    middle = F.substring(F.col(text_col), F.greatest(F.lit(1), F.floor((F.length(F.col(text_col)) - chars) / 2).cast("int")), F.lit(chars))
    known = train.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.rlike(F.col(text_col), F.lit("\\p{L}")))
    rows = known.select(F.col(lang_col).alias("lang"), key.alias("key"), F.col(id_col).cast("string").alias("id"), middle.alias("text"))
    nearest = Window.partitionBy("lang").orderBy("key", "id", "text")
    picked = rows.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= docs_per_lang).drop("n").limit(max_langs * docs_per_lang + 1).collect()
    if len({r["lang"] for r in picked}) > max_langs or len(picked) > max_langs * docs_per_lang:
        raise ValueError(f"more than {max_langs} languages")
    found = sorted((r["id"], r["lang"], r["text"]) for r in picked)
    parts: dict[str, list[bytes]] = {}
    for _, lang, text in found:
        raw = normalized(text)
        at = max(0, (len(raw) - piece_bytes) // 2)
        own = parts.setdefault(lang, [])
        if raw.strip() and sum(map(len, own)) < dict_bytes:
            own.append(raw[at : at + piece_bytes])
    return {k: b"".join(v)[:dict_bytes] for k, v in sorted(parts.items()) if v}


class Classifier:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, window: int, least: int = 128):
        """least: a shorter text is written again and again up to so many bytes. zstandard stores a block raw that saves
        next to nothing, so that alone a few words would have the same size with every dictionary."""
        self.window, self.least = window, least
        self.by_lang = []
        for lang, raw in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by_lang.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language and the margin: the share of bytes that the best saves against the second (1 if it is alone)."""
        if text is None or not _LETTER.search(text) or not self.by_lang:
            return "und", 0.0
        raw = normalized(text)
        if len(raw) < self.least:
            raw *= -(-self.least // len(raw))
        pieces = [raw[i : i + self.window] for i in range(0, len(raw), self.window)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in self.by_lang)
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def least_margin(dictionaries: dict[str, bytes], level: int = 6, window: int = 8192, piece_bytes: int = 1024, most: int = 512) -> float:
    """The margin under which a text counts as none of the languages: a tenth of the median of what pieces of the
    training text have that are classified right by the other half of each dictionary. 0.0005 without such pieces. The
    median hardly differs between tables, where a low percentile hangs on two or three pieces of mixed language.

    At most `most` pieces, or 2 a language, spread evenly over the dictionaries.
    """
    found = []
    halves = [{k: v[: len(v) // 2] for k, v in dictionaries.items()}, {k: v[len(v) // 2 :] for k, v in dictionaries.items()}]
    each = max(1, most // (2 * len(dictionaries) or 1))
    for own, other in (halves, halves[::-1]):
        model = Classifier({k: v for k, v in other.items() if v}, level, window)
        for lang, raw in own.items():
            starts = range(0, len(raw), piece_bytes)
            for at in starts[:: -(-len(starts) // each) or 1]:
                got, margin = model.classify(raw[at : at + piece_bytes].decode("utf-8", "ignore"))
                if got == lang:
                    found.append(margin)
    return max(0.0005, sorted(found)[len(found) // 2] / 10) if found else 0.0005


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", level: int = 6, window: int = 8192, min_margin: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: its id, the columns in keep, lang_pred, score and rejected.

    Null texts and texts without a letter: "und", score 0, rejected. Else the learned language with the fewest bytes
    (ties: the first by name); score is the margin, from 0 to 1; rejected if it is under min_margin, by default
    least_margin(). A single language has nothing to be compared with and keeps all. Texts of every length are read whole. Repeated rows are answered each; an empty table gives an empty one; other columns are
    ignored, whatever their names. No dictionaries at all: every row is "und".
    """
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep))]
    if min_margin is None:
        min_margin = least_margin(dictionaries, level, window)
    kinds = dict(docs.dtypes)
    schema = ", ".join(["`id` " + kinds[id_col], *(f"`keep_{i}` {kinds[c]}" for i, c in enumerate(keep)), "lang_pred string", "score double"])

    def make():
        model = Classifier(dictionaries, level, window)

        def step(batch):
            got = [model.classify(t) for t in batch.column("text").to_pylist()]
            return {n: batch.column(n) for n in ["id", *(f"keep_{i}" for i in range(len(keep)))]} | {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return step

    out = map_rows(docs.select(*columns), schema, make)
    return out.select(F.col("id").alias(id_col), *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", ((F.col("lang_pred") == "und") | (F.col("score") < min_margin)).alias("rejected"))
