"""Results depend on them, so they are the same everywhere."""

# Fixed values.
CHUNK_CHARS = 4000  # passage size, in code points
CHUNK_RANGE = (256, 16000)  # allowed passage sizes
OVERLAP_SHARE = 10  # neighbouring passages share a tenth of their size ...
MAX_OVERLAP = 400  # ... but at most this much
MAX_QUERY_TERMS = 64  # terms of a query used for lexical matching
PATH_WEIGHT = 5  # weight of a term in the path; in the text it is 1
MIN_SHORTLIST = 500  # documents shortlisted by default ...
SHORTLIST_PER_RESULT = 10  # ... or this many per requested result, if more
STATE_LIMIT = 28_000  # bytes of one judgement's query and text
MAX_SPEC_BYTES = 8192  # bytes of one written query
QUERY_FIELDS = ("query", "yes", "no")  # parts of a written query
