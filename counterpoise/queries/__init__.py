"""Named queries over the test tables, each with its SQL twin where SQL can say it.

``QUERIES`` maps a name to a function of (spark, folder); ``ORACLE`` maps it to SQL.
"""

from counterpoise.queries import encoding, files, links, neighbors, oversampling, sampling

MODULES = (encoding, files, sampling, neighbors, oversampling, links)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
