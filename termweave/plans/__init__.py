"""termweave plans"""
