"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import q_bitslice, q_conversation, q_langid, q_learned, q_mincut, q_mixing, q_packing, q_periodic, q_quality, q_sharding, q_simhash, q_urlfilter, q_warc

MODULES = [q_bitslice, q_simhash, q_sharding, q_mixing, q_packing, q_langid, q_learned, q_urlfilter, q_warc, q_quality, q_periodic, q_conversation, q_mincut]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
