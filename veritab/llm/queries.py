"""All queries of this subpackage."""

import corpus_pipeline  # noqa: F401
from veritab.llm import (
    decontamination, host_reputation, html_text, jaccard_join, licenses, manifest, near_dedup, neighbours, passages,
    phrases, pieces, quality, token_files,
)  # noqa: F401
from veritab.llm.base import QUERIES, SQL  # noqa: F401
