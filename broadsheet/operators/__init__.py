"""DataFrame operators: links, articles, archive reads, corpora, classification."""
