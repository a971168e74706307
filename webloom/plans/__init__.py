"""The registered queries over the fixture tables, each with its SQL twin where there is one."""

from webloom.plans import addresses, benchmarking, documents, histories, requests, searching, streams, webpages

MODULES = (documents, webpages, addresses, benchmarking, histories, requests, searching, streams)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
