"""allelora.functions"""
