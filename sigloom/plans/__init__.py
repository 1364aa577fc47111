"""Query plans: named compositions of operators over the test tables, and their SQL counterparts."""
