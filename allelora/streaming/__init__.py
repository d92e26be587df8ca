"""allelora.streaming"""
