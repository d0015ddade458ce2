"""Text retrieval and ranking as PySpark DataFrame operators."""

from gleaner.operators.judging import TOKEN_OVERLAP, BatchScorer, ColumnScorer
from gleaner.operators.query_specs import query_specs
from gleaner.plans.corpus import Corpus, scan
from gleaner.plans.search import (
    one_query,
    read_query,
    rerank,
    search,
    search_documents,
    with_text,
)
from gleaner.session import scratch
from gleaner.sources.fields import DocumentSource, FieldSource
from gleaner.sources.files import FileSource
from gleaner.sources.index import Index
from gleaner.sources.report import report_json, report_tsv
from gleaner.sources.scores import ScoreCache

__all__ = [
    "BatchScorer", "ColumnScorer", "Corpus", "DocumentSource", "FieldSource", "FileSource",
    "Index", "ScoreCache", "TOKEN_OVERLAP", "one_query", "query_specs", "read_query",
    "report_json", "report_tsv", "rerank", "scan", "scratch", "search", "search_documents",
    "with_text",
]
