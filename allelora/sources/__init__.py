"""allelora.sources"""
