"""All registered queries: name -> (query, SQL or None)."""

from venuemill.plans import (
    queries_loop,
    queries_match,
    queries_pages,
    queries_refine,
    queries_score,
    queries_serve,
    queries_text,
)

ALL = {
    **queries_score.QUERIES,
    **queries_text.QUERIES,
    **queries_match.QUERIES,
    **queries_serve.QUERIES,
    **queries_pages.QUERIES,
    **queries_refine.QUERIES,
    **queries_loop.QUERIES,
}
