"""DataFrame operators for document retrieval, knowledge graphs, evaluation and corpus preparation."""
