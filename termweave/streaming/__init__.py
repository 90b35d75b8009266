"""termweave streaming"""
