"""The registered queries: each operator applied to the test tables, with the SQL that must agree."""
