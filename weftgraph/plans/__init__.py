"""Named queries over the test tables, each with its DuckDB SQL where SQL can express it."""
