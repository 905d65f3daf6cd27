"""Scalar functions on node ids, read headers and sequences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The complements of nucleotide codes, IUPAC's ambiguity codes included.
IUPAC = "ACGTUMRWSYKVHDBN"
IUPAC_COMPLEMENT = "TGCAAKYWSRMBDHVN"


def complement(node: Column) -> Column:
    """The same read on the other strand."""
    return node.bitwiseXOR(F.lit(1))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower()))


def oriented(index: Column, sign: Column) -> Column:
    """Node of a pair's index and an orientation."""
    return 2 * index + F.when(sign == "-", 1).otherwise(0)


def normalise_chr(name: Column) -> Column:
    """Cut at the first underscore and put ``chr`` before the rest if it isn't there."""
    short = F.split_part(name, F.lit("_"), F.lit(1))
    return F.when(short.startswith("chr"), short).otherwise(F.concat(F.lit("chr"), short))


def strip_chr(name: Column) -> Column:
    return F.regexp_replace(name, "^chr", "")


def extract_id(header: Column) -> Column:
    """The id of ``read=<id>,...``; other headers are their own ids up to the first blank."""
    named = F.split_part(F.split_part(header, F.lit(","), F.lit(1)), F.lit("="), F.lit(2))
    return F.when(header.startswith("read="), named).otherwise(F.split_part(header, F.lit(" "), F.lit(1)))


def header_field(header: Column, name: str, kind: str) -> Column:
    """A field of a simulated read's header, e.g. ``start=100``; null if it's missing."""
    value = {"bigint": r"-?\d+", "string": r"[^\s]+"}[kind]
    return F.nullif(F.regexp_extract(header, rf"(?:^|\s){name}=({value})", 1), F.lit("")).cast(kind)


def strand_of(header: Column) -> Column:
    sign = header_field(header, "strand", "string")
    return F.when(sign == "+", 1).when(sign == "-", -1)


def edit_similarity(src: Column, dst: Column, overlap: Column) -> Column:
    """1 less the edit distance, per base, of the source's end and the destination's beginning; 0 without overlap."""
    return F.when(overlap == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(F.right(src, overlap), F.left(dst, overlap)) / overlap)


def path_suffix(seq: Column, overlap: Column) -> Column:
    """What a sequence adds to a path that covers its first ``overlap`` bases: nothing if that's all of it."""
    return F.when(overlap >= F.length(seq), F.lit("")).otherwise(F.substring(seq, overlap + 1, F.length(seq)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))
