"""What the queries and the pipeline set alike."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from pairstrand.llm import quality

#: The public byte-level vocabulary: its file, its number of ids, and the id that ends a document.
VOCABULARY, VOCABULARY_SIZE, END_ID = public_tokenizers.path("byte_bpe_50k.json"), 50_257, 2
#: Of the flat files without index: an id that no text contains, for ids of plain text may equal 2.
SEPARATOR_ID = 50_257
#: Bytes of a string that the pipeline removes where it is repeated: fifty words of four letters and a blank, so that passages
#: of over fifty words are caught (the shortest of ``benchmark`` has 271 bytes).
PASSAGE = 250



def quality_forest(docs: DataFrame, labels: DataFrame) -> quality.Forest:
    """Trees grown without the labels of the held-out fold."""
    return quality.fit(docs, labels.where(quality.fold(labels["doc_id"]) != 2))
