"""Table-to-table operators: lines, windows, extraction, answers, graph, scoring."""
