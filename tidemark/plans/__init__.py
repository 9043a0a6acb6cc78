"""Named queries and, where SQL can state them, their reference SQL."""
