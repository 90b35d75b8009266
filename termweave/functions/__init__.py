"""termweave functions"""
