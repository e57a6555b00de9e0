"""Words that must be the same for equal results."""

#: Never names of tables or columns.
RESERVED = frozenset("""
SELECT WHERE AND OR IN NOT NULL IS ON SET VALUES DUAL UNNEST LATERAL ONLY INTO CASE WHEN THEN ELSE END GROUP ORDER
HAVING LIMIT OFFSET UNION INTERSECT EXCEPT AS WITH BY DISTINCT ALL EXISTS BETWEEN LIKE ILIKE SIMILAR OVER PARTITION
ROWS RANGE PRECEDING FOLLOWING CURRENT UNBOUNDED TABLE VIEW FUNCTION PROCEDURE INDEX TRUE FALSE NEW OLD LANGUAGE
RETURNS RETURN DECLARE BEGIN IF ELSIF LOOP WHILE FOR FOREACH PERFORM EXECUTE RAISE NOTICE EXCEPTION USING FOUND
RECURSIVE TOP ROWNUM ROWID NOCOUNT TRAN TRANSACTION COMMIT ROLLBACK GO USE TEMPORARY TEMP GLOBAL VOLATILE REPLACE
IGNORE STRAIGHT_JOIN CROSS NATURAL INNER LEFT RIGHT FULL OUTER APPLY TABLESAMPLE PIVOT UNPIVOT CONNECT NOCYCLE PRIOR
LEVEL SYSDATE SYSTIMESTAMP NEXTVAL CURRVAL SEQUENCE ROWTYPE TYPE CURSOR OPEN FETCH CLOSE BULK COLLECT FORALL MULTISET
PIPE ROW PIPELINED DETERMINISTIC PARALLEL_ENABLE AUTONOMOUS_TRANSACTION
""".split())
#: May follow a table reference without being its alias.
NO_ALIAS = RESERVED | {"JOIN", "WINDOW", "RETURNING", "QUALIFY", "SAMPLE"}
#: Calls in which FROM names no table.
FROM_CALLS = frozenset({"EXTRACT", "SUBSTRING", "SUBSTR", "TRIM", "OVERLAY", "POSITION"})
#: Begin a query in parentheses, not a join tree.
LIST_WORDS = frozenset({"SELECT", "WITH", "VALUES"})
#: Begin a part of a column list that is no column.
NOT_COLUMNS = frozenset({"INDEX", "KEY", "FULLTEXT", "SPATIAL", "LIKE", "PERIOD"})
#: The first of these ends a column's type.
MODIFIERS = frozenset({
    "NOT NULL", "NULL", "PRIMARY KEY", "UNIQUE", "DEFAULT", "REFERENCES", "CHECK", "CONSTRAINT", "COLLATE", "GENERATED",
    "AUTO_INCREMENT", "AUTOINCREMENT", "IDENTITY", "COMMENT", "ON UPDATE", "CHARACTER SET", "CHARSET",
})
#: Any of these ends a default.
AFTER_DEFAULT = MODIFIERS - {"DEFAULT", "AUTOINCREMENT", "IDENTITY", "CHARACTER SET", "CHARSET"}
#: Clauses that end a select list, and SELECT.
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT")
#: Options between a routine's head and its IS or AS.
ROUTINE_OPTIONS = frozenset({"AUTHID", "DETERMINISTIC", "PIPELINED", "PARALLEL_ENABLE", "RESULT_CACHE"})
#: Begin the declarations, or the block, of a routine.
DECLARATIONS = frozenset({"BEGIN", "CURSOR", "TYPE", "PRAGMA", "PROCEDURE", "FUNCTION"})
