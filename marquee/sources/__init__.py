"""Operators that read saved pages, crawl rules and crawl state."""
