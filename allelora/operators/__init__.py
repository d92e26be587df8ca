"""allelora.operators"""
