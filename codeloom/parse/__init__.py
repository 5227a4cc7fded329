"""Symbol and import extraction from source text, as Spark window queries.

Each file is cut into tokens inside its row, the tokens become rows, and running windows
over (project, file_path) recover lines, nesting and statement starts. What remains is one
row per statement, read with regular expressions. No Python runs on the executors.
"""
