"""DataFrame operators: version store, history, ranked search, crawl."""
