"""The answer key. No module that builds states may import this package."""
