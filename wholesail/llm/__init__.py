"""Training-data operators: PII pseudonyms, near-dedup, toxicity, exact search, mixing, tokenising,
URL filtering, token attribution and quality.  Each module holds one operator with its own general
interface; ``queries`` derives the registered ``opN_*`` queries from them.  Nothing else in the
library imports this package."""
