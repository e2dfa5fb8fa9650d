"""Preparation of text collections for training: ten operators over chat messages, web pages and their links."""
