"""Outline analytics on Spark.

Outline documents (headings with keywords, tags, properties, time stamps, logs and bodies) as a set
of DataFrames, and what one asks of them: composable predicates that Catalyst turns into semi, anti
and existence joins, hierarchy and inheritance, tallies, quality rules, incremental loading,
similarity and exports.
"""
