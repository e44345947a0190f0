"""The queries of this package: name to function, and DuckDB SQL where SQL can tell the result."""

from . import exact_topk, html_text, jaccard_join, media, mixing, packing, quality, token_files, url_filter, warc_revisits

MODULES = (packing, mixing, jaccard_join, url_filter, quality, html_text, exact_topk, token_files, media, warc_revisits)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
