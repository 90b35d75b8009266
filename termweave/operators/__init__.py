"""termweave operators"""
