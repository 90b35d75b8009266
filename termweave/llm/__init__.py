"""termweave llm"""
