"""Captions, labels, errors and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of captions.
STOP_WORDS = "the a an and with of in on at for to is are this that there it from by near view photo picture image".split()
POSITIVE = "happy smiling friends celebration sunny beautiful".split()
NEGATIVE = "sad alone rainy dark angry upset".split()
CALM = "calm peaceful serene quiet relaxed".split()
SENSITIVE = "blood weapon gun knife nude naked violence fight injury wound".split()
SENSITIVE_LABELS = ("weapon", "knife")
STRIPPED = ".,!?;:()[]{}\"' "
# Parts of messages that tell final errors from temporary ones.
FINAL_ERRORS = ("No such file or directory", "unsupported image format", "cannot identify image file")


def caption_tags(caption: Column, max_tags: int = 15) -> Column:
    """Distinct words of a caption in order: stripped, lower-cased, over two characters, no stop words or numbers."""
    words = F.transform(F.split(F.coalesce(caption, F.lit("")), r"\s+"), lambda w: F.lower(F.btrim(w, F.lit(STRIPPED))))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS) & ~w.rlike("^[0-9]+$"))
    return F.slice(F.array_distinct(kept), 1, max_tags)


def _hits(text: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total


def caption_mood(caption: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, calm: list[str] = CALM) -> Column:
    """The mood with most keywords in the caption; ties go to positive, then negative; null if there are none."""
    text = F.lower(caption)
    p, n, c = (_hits(text, w) for w in (positive, negative, calm))
    return F.when(F.greatest(p, n, c) == 0, None).when((p >= n) & (p >= c), "positive").when(n >= c, "negative").otherwise("calm")


def caption_sensitive(caption: Column, labels: Column) -> Column:
    """A sensitive word in the caption (also inside words), or a sensitive label."""
    in_labels = F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(x).isin(*SENSITIVE_LABELS))
    return F.lower(F.coalesce(caption, F.lit(""))).rlike("|".join(SENSITIVE)) | F.coalesce(in_labels, F.lit(False))


def embedding_text(caption: Column, tags: Column) -> Column:
    """Caption and tags joined by spaces; null if that is empty."""
    parts = F.filter(F.concat(F.array(caption), F.coalesce(tags, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    text = F.trim(F.array_join(parts, " "))
    return F.when(text != "", text)


def contains_text(text: Column) -> Column:
    return F.coalesce(F.length(F.btrim(text, F.lit(" \t\n\r\f\v"))) > 3, F.lit(False))


def classify_error(message: Column) -> Column:
    """final or temp: final parts are looked for first, and what is unknown is temporary."""
    final = F.lit(False)
    for s in FINAL_ERRORS:
        final = final | message.contains(s)
    return F.when(F.coalesce(final, F.lit(False)), "final").otherwise("temp")


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    data = content.cast("binary")
    return {"sha256": lambda: F.sha2(data, 256), "sha512": lambda: F.sha2(data, 512), "md5": lambda: F.md5(data), "sha1": lambda: F.sha1(data)}[algorithm]()


def event_key(event_type: Column, src: Column, dest: Column) -> Column:
    """md5 of type|source, and |destination if there is one; paths lower-cased."""
    return F.md5(F.concat_ws("|", event_type, F.lower(src), F.when(dest != "", F.lower(dest))))


def object_labels(objects: Column, min_score: float = 0.7, limit: int = 10) -> Column:
    """Sorted distinct labels of the first `limit` objects (label, score) that score enough."""
    kept = F.slice(F.filter(objects, lambda o: o["score"] >= min_score), 1, limit)
    return F.array_sort(F.array_distinct(F.transform(kept, lambda o: o["label"])))
