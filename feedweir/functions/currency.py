"""ISO 4217 currencies as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Active ISO 4217 codes, and those whose minor unit isn't a hundredth.
ACTIVE = """
AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY
COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK
JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD
NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB
TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW UZS VED VES VND VUV WST XAF XCD XCG XDR XOF XPF YER ZAR ZMW ZWG
""".split()
NO_DECIMALS = "BIF CLP DJF GNF ISK JPY KMF KRW PYG RWF UGX UYI VND VUV XAF XOF XPF".split()
THREE_DECIMALS = "BHD IQD JOD KWD LYD OMR TND".split()
FOUR_DECIMALS = "CLF UYW".split()


def is_active(code: Column) -> Column:
    return code.isin(*ACTIVE)


def minor_units(code: Column) -> Column:
    """Decimal places that an amount of the currency may have."""
    return F.when(code.isin(*NO_DECIMALS), 0).when(code.isin(*THREE_DECIMALS), 3).when(code.isin(*FOUR_DECIMALS), 4).otherwise(2)
