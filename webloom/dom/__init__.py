"""HTML trees on the standard library's parser: nodes, selectors, extraction, markdown. Plain Python, shipped to executors."""
