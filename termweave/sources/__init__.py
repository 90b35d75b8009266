"""termweave sources"""
